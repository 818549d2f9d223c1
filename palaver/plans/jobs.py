"""End-to-end jobs: dumps to threads, threads to a report, vectors, labels and correlations.

Each job reads stored tables, chains operators into one plan and writes a stored table, so
that a later job starts from columns on disk and not from the raw dumps. What it stages on the
way is removed when it ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palaver.operators import answers as ans
from palaver.operators import authors as auth
from palaver.operators import clean, inference, profile, sampling, similarity, threads
from palaver.operators.segments import MAX_ROWS
from palaver.session import key_table, scratch_tables, ship_package, stage
from palaver.sources import jsonl, tables
from palaver.sources.arrow_ipc import register_arrow_ipc


def filter_dump(spark: SparkSession, path: str, keys: tuple[str, ...], suffix: str = "_filtered") -> str:
    """Copy a JSON-lines dump with only the given keys; returns where it went."""
    out = jsonl.suffixed_path(path, suffix)
    jsonl.write_jsonl(jsonl.project_json_keys(jsonl.read_lines(spark, path), keys), out)
    return out


def build_threads(
    spark: SparkSession,
    submissions_path: str,
    comments_path: str,
    out: str,
    max_comments_per_row: int = MAX_ROWS,
) -> dict[str, int]:
    """Raw dumps to a thread store; returns how many lines were read and how many were bad.

    Each dump is parsed and cleaned once into a stored table, as nesting passes over them twice.
    """
    subs_seen, coms_seen = Observation("submissions"), Observation("comments")
    raw_subs = jsonl.read_jsonl(spark, submissions_path, clean.RAW_SUBMISSION_SCHEMA, observation=subs_seen)
    raw_coms = jsonl.read_jsonl(spark, comments_path, clean.RAW_COMMENT_SCHEMA, observation=coms_seen)
    with scratch_tables(spark):
        submissions = stage(clean.clean_submissions(raw_subs), "submissions")
        comments = stage(clean.clean_comments(raw_coms), "comments")
        nested = threads.assemble_threads(submissions, comments, max_comments_per_row)
        tables.write_table(nested, out, tables.THREAD_SCHEMA)
    return {
        "submission_lines": subs_seen.get["n_lines"],
        "bad_submission_lines": subs_seen.get["n_bad"],
        "comment_lines": coms_seen.get["n_lines"],
        "bad_comment_lines": coms_seen.get["n_bad"],
    }


def import_arrow(spark: SparkSession, path: str, out: str) -> None:
    """Arrow IPC files of nested threads to a thread store; one row per thread counts as segment 0."""
    ship_package(spark)
    register_arrow_ipc(spark)
    found = spark.read.format("arrow_ipc").load(path)
    if "segment" not in found.columns:
        found = found.withColumn("segment", F.lit(0))
    tables.write_table(found, out, tables.THREAD_SCHEMA)


def export_arrow(spark: SparkSession, threads_path: str, out: str) -> None:
    """A thread store to Arrow IPC files, zstd-compressed, one per task."""
    ship_package(spark)
    register_arrow_ipc(spark)
    stored = spark.read.schema(tables.THREAD_SCHEMA).parquet(threads_path)
    stored.write.format("arrow_ipc").mode("append").save(out)


def profile_threads(spark: SparkSession, threads_path: str, out: str) -> DataFrame:
    """Write the text report of a thread store; returns its long form."""
    stored = spark.read.schema(tables.THREAD_SCHEMA).parquet(threads_path)
    comments = threads.explode_comments(stored, fields=("body", "ups", "downs", "author"))
    with scratch_tables(spark):
        stats = stage(profile.thread_report(threads.thread_heads(stored), comments), "report", keep=True)
    tables.write_report(profile.render_report(stats, threads_path), out)
    return stats


def classify_questions(
    spark: SparkSession,
    threads_path: str,
    factory: Callable[[], inference.Generator],
    out: str,
    n: int | None = None,
    profile_: ResourceProfile | None = None,
) -> None:
    """Label all titles, or a sample of ``n``, with the user's chat model; ``profile_`` asks for resources."""
    ship_package(spark)
    heads = threads.thread_heads(spark.read.schema(tables.THREAD_SCHEMA).parquet(threads_path))
    titled = heads.where(F.col("title").isNotNull()).select("id", "title")
    chosen = titled if n is None else sampling.sample_titles(heads, n)
    with scratch_tables(spark):
        labelled = inference.classify_texts(chosen, factory, profile=profile_)
        tables.write_table(labelled, out, tables.CLASSIFIED_SCHEMA)


def style_vectors(
    spark: SparkSession,
    threads_path: str,
    factory: Callable[[], inference.Embedder],
    out: str,
    min_comments: int = auth.MIN_COMMENTS,
    min_chars: int = auth.STYLE_MIN_CHARS,
    profile_: ResourceProfile | None = None,
) -> None:
    """Mean vector of each prolific author's long comments."""
    ship_package(spark)
    stored = spark.read.schema(tables.THREAD_SCHEMA).parquet(threads_path)
    comments = threads.explode_comments(stored, fields=("id", "body", "author"))
    with scratch_tables(spark):
        chosen = auth.prolific_comments(comments, min_comments, min_chars)
        vectors = inference.embed_authors(chosen, factory, profile=profile_, segments_per_task=inference.SEGMENTS_PER_TASK)
        tables.write_table(vectors, out, tables.STYLE_SCHEMA)


def answer_vectors(
    spark: SparkSession,
    threads_path: str,
    classified_path: str,
    styles_path: str,
    factory: Callable[[], inference.Embedder],
    out: str,
    min_chars: int = ans.ANSWER_MIN_CHARS,
    profile_: ResourceProfile | None = None,
) -> None:
    """Unit vector of the oldest long answer of each styled author to each valid question."""
    ship_package(spark)
    stored = spark.read.schema(tables.THREAD_SCHEMA).parquet(threads_path)
    comments = threads.explode_comments(stored, fields=("id", "body", "created_utc", "author"))
    classified = spark.read.schema(tables.CLASSIFIED_SCHEMA).parquet(classified_path)
    with scratch_tables(spark):
        questions = key_table(ans.valid_questions(classified), "questions")
        authors = tables.read_parquet(spark, styles_path, ["author"])
        oldest = ans.oldest_answer(ans.answer_candidates(comments, questions, authors, min_chars))
        tables.write_table(inference.embed_answers(oldest, factory, profile=profile_), out, tables.ANSWER_SCHEMA)


def correlate(
    spark: SparkSession, answers_path: str, styles_path: str, max_pairs: int | None = None
) -> dict[str, DataFrame]:
    """Correlation of semantic and style similarity, and the data behind each layer of its plot.

    All pairs count unless ``max_pairs`` names a budget; ``left_out`` then holds what it cut off. Pairs are formed twice:
    for their sums and extremes, from which all fits follow, and for the counts of both densities. The layers, a few hundred
    rows each, are stored; tables with a row for each answer are removed.
    """
    ship_package(spark)
    answers = spark.read.schema(tables.ANSWER_SCHEMA).parquet(answers_path)
    styles = spark.read.schema(tables.STYLE_SCHEMA).parquet(styles_path).select("author", "embedding")
    with scratch_tables(spark):
        plan = similarity.plan_pairs(answers, styles, max_pairs)
        extent = plan.extent()
        histograms, hexagons = similarity.pair_density(plan)
        left_out = [(plan.left_out["questions"], plan.left_out["pairs"])]
        layers = {
            "left_out": spark.createDataFrame(left_out, "n_questions bigint, n_pairs bigint"),
            "quality": similarity.pair_quality(plan.questions),
            "correlation": similarity.similarity_correlation(extent),
            "ellipse": similarity.confidence_ellipse(extent),
            "regression": similarity.regression_grid(extent),
            "histograms": histograms,
            "hexagons": hexagons,
        }
        return {name: stage(layer, f"layer-{name}", keep=True) for name, layer in layers.items()}


def inspect_labels(spark: SparkSession, classified_path: str, n: int = sampling.EXAMPLES_PER_LABEL) -> dict[str, DataFrame]:
    """Label counts and shares, and sampled titles of each label."""
    classified = spark.read.schema(tables.CLASSIFIED_SCHEMA).parquet(classified_path)
    return {
        "distribution": inference.label_distribution(classified),
        "examples": sampling.label_examples(classified, n).select("title", "label").orderBy(F.col("label").desc()),
    }
