"""The registered queries of this subpackage: each operator over its whole table, and digests of its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import (
    chat,
    exact_search,
    graph_search,
    language,
    ngram,
    packing,
    paragraphs,
    periods,
    pieces,
    quality,
    shards,
    simhash,
    variants,
)
from palaver.llm.common import table
from palaver.session import ship_package

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


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_vocabulary() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@_query
def op1_paragraph_minhash(spark, sf):
    return paragraphs.repeated_spans(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@_query
def op2_sentencepiece(spark, sf):
    coded = pieces.encode_pieces(table(spark, sf, "documents"), piece_model(), decoded=True)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op3_language_id(spark, sf):
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    names, model = language.fit_text_model(docs)
    both = language.document_evidence(docs).unionByName(language.page_evidence(pages), allowMissingColumns=True)
    judged = language.identify(both, names, model)
    return judged.select("doc_id", "page_id", "language", F.round("certainty", 6).alias("certainty"), "text_language", "accepted")


@_query
def op4_graph_neighbours(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return graph_search.nearest(vectors.where(F.col("vec_id") % 50 == 0), vectors)


@_query
def op5_splitter_shards(spark, sf):
    placed = shards.assign_shards(table(spark, sf, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op6_backoff_scores(spark, sf):
    return ngram.score_texts(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@_query
def op7_dp_packing(spark, sf):
    packed = packing.pack(table(spark, sf, "documents"), byte_vocabulary())
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@_query
def op8_chat_windows(spark, sf):
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(added)
    read = chat.read_back(chat.format_windows(rows))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    window = F.struct("first", F.size("turns").alias("n"), written.alias("turns"), "loss_text", "chars")
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(window)).alias("w"))
    loss = F.array_join("w.loss_text", "")
    total = lambda name: F.aggregate(F.col("w")[name], F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


@_query
def op9_simhash_ball(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@_query
def op10_exact_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return exact_search.exact_top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


@_query
def op11_spelling_variants(spark, sf):
    runs = variants.letter_runs(table(spark, sf, "documents"))
    # The contract's slips of the pen: one letter of some runs is left out.
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    drawn = runs.select("word", h.alias("h"), (h % F.char_length("word")).cast("int").alias("at"))
    short = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
    slipped = drawn.select(F.when(F.col("h") % 31 == 0, short).otherwise(F.col("word")).alias("word"))
    return variants.spelling_variants(variants.word_counts(slipped))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the contract's runs: in one document of ten, the words from a on repeat the p words there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), h.alias("h"))
    rows = rows.select("*", F.when(F.col("h") % 10 == 0, words).otherwise(F.array().cast("array<string>")).alias("words"))
    rows = rows.select("*", F.size("words").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    rows = rows.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    rows = rows.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@_query
def op12_periodic_runs(spark, sf):
    found = periods.periodic_runs(with_planted_runs(table(spark, sf, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("period"))))
    rows = found.select("*", longest.alias("top"))
    return rows.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"), F.expr("(1000 * top.length) div (-top.period)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op13_quality_classifier(spark, sf):
    scored = quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


_TOP_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_topk": _TOP_SQL}
