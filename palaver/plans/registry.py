"""The registered queries: every operator over the shared views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions.labels import parse_label, render_prompt
from palaver.functions.standins import HashingEmbedder, keyword_generator
from palaver.functions.vectors import l2_normalize, mean_vectors, nan_to_zero
from palaver.operators import answers as ans
from palaver.operators import authors as auth
from palaver.operators import clean, inference, profile, sampling, similarity, sketches, threads
from palaver.plans.fixtures import table, view
from palaver.plans.oracles import PARAMS
from palaver.session import key_table, scratch_path, ship_package, stage
from palaver.sources import jsonl, manifest, tables
from palaver.sources.arrow_ipc import register_arrow_ipc

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    _QUERIES[fn.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- inputs ---------------------------------------------------------------------------------


def _subs(spark, sf):
    return clean.clean_submissions(view(spark, sf, "raw_submissions"))


def _coms(spark, sf):
    return clean.clean_comments(view(spark, sf, "raw_comments"))


def _matched(spark, sf):
    return clean.matched_comments(_coms(spark, sf), _subs(spark, sf))


def _flat(spark, sf):
    return threads.flat_comments(_matched(spark, sf))


def _threads(spark, sf):
    return threads.assemble_threads(_subs(spark, sf), _coms(spark, sf), PARAMS["comments_per_row"])


def _classified(spark, sf):
    replies = view(spark, sf, "raw_completions")
    return replies.select("id", "title", parse_label(F.col("completion")).alias("label")).where(F.col("label").isNotNull())


def _prolific(spark, sf):
    return auth.prolific_authors(_flat(spark, sf), PARAMS["min_comments"], PARAMS["style_min_chars"])


def _candidates(spark, sf):
    questions = key_table(ans.valid_questions(_classified(spark, sf)), "questions")
    authors = key_table(_prolific(spark, sf).select("author"), "authors")
    return ans.answer_candidates(_flat(spark, sf), questions, authors, PARAMS["answer_min_chars"])


def _styles(spark, sf):
    return mean_vectors(view(spark, sf, "comment_vectors"), "author", "embedding")


def _pairs(spark, sf):
    styles = stage(_styles(spark, sf), "styles")
    return similarity.plan_pairs(view(spark, sf, "answer_vectors"), styles, row_key=("author", "vec_id"))


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("-"))


def _listed(comments: Column) -> Column:
    """A comment list as text, so that engines with different list types can be compared."""
    return F.array_join(
        F.transform(
            comments,
            lambda c: F.concat_ws("|", c["id"], _text(c["ups"]), _text(c["downs"]), _text(c["created_utc"]), c["author"], F.md5(c["body"])),
        ),
        ",",
    )


def _shown(t: DataFrame) -> DataFrame:
    lists = F.col("top_level_comments")
    chars = F.aggregate(lists, F.lit(0), lambda s, c: s + F.char_length(c["body"])).cast("bigint")
    return t.select(
        *[c for c in t.columns if c != "top_level_comments"],
        F.coalesce(F.array_size(lists), F.lit(0)).cast("bigint").alias("n_comments"),
        _listed(lists).alias("comments"),
        chars.alias("n_chars"),
    )


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def _by_dim(df: DataFrame, vec: str, *keys: str, digits: int = 6) -> DataFrame:
    """One row per vector element."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), digits)
    )


# --- cleaning and threads -------------------------------------------------------------------


@_query
def clean_submissions(spark, sf):
    return _subs(spark, sf)


@_query
def clean_comments(spark, sf):
    return _coms(spark, sf)


@_query
def matched_comments(spark, sf):
    return _matched(spark, sf)


@_query
def assemble_threads(spark, sf):
    return _shown(_threads(spark, sf))


@_query
def thread_preview(spark, sf):
    subs, coms = threads.first_threads(_subs(spark, sf), _coms(spark, sf), PARAMS["preview"])
    nested = threads.assemble_threads(subs, coms, PARAMS["comments_per_row"])
    return _shown(threads.thread_preview(nested, PARAMS["preview"])).select(
        "id", "title", "segment", "n_comments", "comments"
    )


@_query
def explode_comments(spark, sf):
    return threads.explode_comments(_threads(spark, sf), keep_empty=True)


# --- profile --------------------------------------------------------------------------------


@_query
def general_metadata(spark, sf):
    return _rounded(profile.general_metadata(_subs(spark, sf)), "nsfw_share")


@_query
def comment_count_distribution(spark, sf):
    sizes = profile.thread_sizes(_subs(spark, sf), threads.flat_comments(_coms(spark, sf)))
    return _rounded(profile.comment_count_distribution(sizes), "count_mean", "count_std")


@_query
def submission_content_stats(spark, sf):
    return _rounded(profile.submission_content_stats(_subs(spark, sf)), "title_len_mean", "score_mean")


@_query
def comment_content_stats(spark, sf):
    return _rounded(profile.comment_content_stats(_flat(spark, sf)), "body_len_mean", "ups_mean", "downs_mean")


@_query
def author_overlap(spark, sf):
    return _rounded(profile.author_overlap(_subs(spark, sf), _flat(spark, sf)), "share_both")


@_query
def author_overlap_sketch(spark, sf):
    subs, coms = _subs(spark, sf), _flat(spark, sf)
    month = F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM")
    parts = sketches.author_sketches(subs.withColumn("month", month), coms.withColumn("month", month), "month")
    estimate = sketches.author_overlap_estimate(stage(parts, "author-sketches"))
    return sketches.estimate_beside_count(estimate, profile.author_overlap(subs, coms))


@_query
def author_union(spark, sf):
    return profile.author_union(_subs(spark, sf), _flat(spark, sf))


@_query
def author_intersection(spark, sf):
    return profile.author_intersection(_subs(spark, sf), _flat(spark, sf))


@_query
def thread_report(spark, sf):
    return profile.render_report(profile.thread_report(_subs(spark, sf), _flat(spark, sf)))


# --- selection ------------------------------------------------------------------------------


@_query
def prolific_authors(spark, sf):
    return _prolific(spark, sf)


@_query
def author_bodies(spark, sf):
    lists = auth.author_bodies(
        _flat(spark, sf), PARAMS["min_comments"], PARAMS["style_min_chars"], PARAMS["bodies_per_row"]
    )
    return lists.select(
        "author",
        "segment",
        F.array_size("bodies").cast("bigint").alias("n_bodies"),
        F.array_join(F.transform("bodies", lambda b: F.md5(b)), ",").alias("bodies"),
    )


@_query
def valid_questions(spark, sf):
    return ans.valid_questions(_classified(spark, sf))


@_query
def answer_candidates(spark, sf):
    return _candidates(spark, sf)


@_query
def oldest_answer(spark, sf):
    return ans.oldest_answer(_candidates(spark, sf))


# --- labels ---------------------------------------------------------------------------------


@_query
def render_prompts(spark, sf):
    titled = _subs(spark, sf).where(F.col("title").isNotNull())
    return titled.select("id", F.inline(render_prompt(F.col("title"))))


@_query
def parse_labels(spark, sf):
    replies = view(spark, sf, "raw_completions")
    return replies.select("id", "completion", parse_label(F.col("completion")).alias("label"))


@_query
def classify_titles(spark, sf):
    titled = _subs(spark, sf).where(F.col("title").isNotNull())
    return inference.classify_texts(titled, keyword_generator)


@_query
def label_distribution(spark, sf):
    return _rounded(inference.label_distribution(_classified(spark, sf)), "share", "valid_share", "invalid_share")


@_query
def label_examples(spark, sf):
    return sampling.label_examples(_classified(spark, sf), PARAMS["examples"])


@_query
def sample_titles(spark, sf):
    return sampling.sample_titles(_subs(spark, sf), PARAMS["sample"])


# --- vectors --------------------------------------------------------------------------------


@_query
def clean_vectors(spark, sf):
    cleaned = view(spark, sf, "answer_vectors").select("vec_id", nan_to_zero(F.col("embedding")).alias("v"))
    flat = _by_dim(cleaned, "v", "vec_id")
    infinite = F.abs(F.col("value")) == F.lit(float("inf"))
    return flat.withColumn("value", F.when(infinite, F.lit(999.0)).otherwise(F.col("value")))


@_query
def normalize_vectors(spark, sf):
    unit = table(spark, sf, "embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("u"))
    return _by_dim(unit, "u", "vec_id")


@_query
def author_style_vectors(spark, sf):
    return _by_dim(_styles(spark, sf), "embedding", "author", "num_comments_used")


@_query
def vector_table_schema(spark, sf):
    path = scratch_path(spark, "styles")
    tables.write_table(_styles(spark, sf), path, tables.STYLE_SCHEMA)
    stored = tables.read_parquet(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return stored.select(
        "author",
        "num_comments_used",
        F.array_size("embedding").alias("width"),
        F.typeof("embedding").alias("embedding_type"),
        F.typeof("num_comments_used").alias("count_type"),
        F.round(total, 5).alias("total"),
    )


@_query
def embed_comments(spark, sf):
    chosen = auth.prolific_comments(_flat(spark, sf), PARAMS["min_comments"], PARAMS["style_min_chars"])
    vectors = inference.embed_authors(chosen, partial(HashingEmbedder, PARAMS["width"]))
    return _by_dim(vectors, "embedding", "author", "num_comments_used")


@_query
def embed_answers(spark, sf):
    chosen = ans.oldest_answer(_candidates(spark, sf))
    vectors = inference.embed_answers(chosen, partial(HashingEmbedder, PARAMS["width"]))
    return _by_dim(vectors, "embedding", "question_id", "author", digits=5)


# --- similarity -----------------------------------------------------------------------------


@_query
def pair_budget(spark, sf):
    sizes = similarity.question_sizes(view(spark, sf, "answer_vectors"), _styles(spark, sf))
    return similarity.pair_budget(sizes, PARAMS["budget"])


@_query
def pair_quality(spark, sf):
    return similarity.pair_quality(similarity.question_sizes(view(spark, sf, "answer_vectors"), _styles(spark, sf)))


@_query
def pair_similarity(spark, sf):
    result = similarity.pair_similarity(_pairs(spark, sf))
    sums = [c for c in result.columns if c.startswith("sum_")]
    return _rounded(_rounded(result, *sums, digits=3), "min_x", "max_x", "min_y", "max_y")


@_query
def similarity_correlation(spark, sf):
    fit = similarity.similarity_correlation(similarity.pair_sums(_pairs(spark, sf)))
    return _rounded(fit, "r", "p_value", "slope", "intercept", "r2")


@_query
def confidence_ellipse(spark, sf):
    rings = similarity.confidence_ellipse(similarity.pair_sums(_pairs(spark, sf)))
    return _rounded(rings, "mean_x", "mean_y", "radius_x", "radius_y", "scale_x", "scale_y")


@_query
def regression_grid(spark, sf):
    return _rounded(similarity.regression_grid(similarity.pair_extent(_pairs(spark, sf))), "x", "y_hat")


@_query
def marginal_histograms(spark, sf):
    return _rounded(similarity.marginal_histograms(_pairs(spark, sf)), "lo", "hi")


@_query
def hexbin_density(spark, sf):
    return _rounded(similarity.hexbin_density(_pairs(spark, sf)), "x", "y", "log10_n")


# --- sources and sinks ----------------------------------------------------------------------


@_query
def jsonl_scan(spark, sf):
    path = scratch_path(spark, "lines")
    jsonl.write_jsonl(view(spark, sf, "json_lines"), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "body", "author", "ups", "score")])
    return jsonl.read_jsonl(spark, path, schema)


@_query
def json_key_projection(spark, sf):
    keys = ("id", "body", "ups", "score", "author", "missing")
    return jsonl.project_json_keys(view(spark, sf, "json_lines"), keys)


@_query
def link_manifest(spark, sf):
    found = manifest.extract_link_manifest(view(spark, sf, "link_pages"), keep=("page_id",))
    return manifest.exclude_names(found, PARAMS["excluded"])


@_query
def manifest_anti_join(spark, sf):
    """Links whose name is on no page of a fifth of the pages: a table of names, so an anti join."""
    found = stage(link_manifest(spark, sf), "links")
    return manifest.exclude_names(found, found.where(F.col("page_id") % 5 == 0).select("name").distinct())


@_query
def parquet_projection(spark, sf):
    return tables.read_parquet(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "n_chars"])


@_query
def arrow_ipc_roundtrip(spark, sf):
    register_arrow_ipc(spark)
    path = scratch_path(spark, "threads")
    stored = tables.conform(_threads(spark, sf), tables.THREAD_SCHEMA)
    stored.write.format("arrow_ipc").mode("append").save(path)
    shown = _shown(spark.read.format("arrow_ipc").load(path))
    return shown.withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))
