"""A third of all rows on one key: joins are split, and results stay whole."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.functions.standins import HashingEmbedder
from palaver.operators import answers, authors, clean, inference, profile, threads
from palaver.operators import similarity as sim
from palaver.session import stage

DOCS = "/root/testdata/sf0.01/documents.parquet"
VECTORS = "/root/testdata/sf0.01/embeddings.parquet"

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def small_thresholds(spark, monkeypatch):
    """Every table but the list of crowded keys counts as large, every partition above some kilobytes as skewed."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    for module in ("palaver.session", "palaver.operators.similarity", "palaver.operators.authors"):
        monkeypatch.setattr(f"{module}.small_side", lambda df, rows, limit=0: df)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def comments(spark):
    docs = spark.read.parquet(DOCS).repartition(12)
    third = F.col("doc_id") % 3
    return stage(
        docs.select(
            F.when(third == 0, "hot").otherwise(F.concat(F.lit("q"), (F.col("doc_id") % 40).cast("string"))).alias("question_id"),
            F.col("doc_id").cast("string").alias("comment_id"),
            F.col("text").alias("body"),
            F.lit(1).cast("bigint").alias("ups"),
            F.lit(0).cast("bigint").alias("downs"),
            F.col("n_chars").alias("created_utc"),
            F.when(third == 1, "hot").otherwise(F.concat(F.lit("a"), (F.col("doc_id") % 50).cast("string"))).alias("author"),
        ),
        "skewed",
    )


def _split_joins(df):
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return rows, len(re.findall(r"Join\(skew=true\)", plan))


def test_matching(spark, comments, small_thresholds):
    links = comments.select(
        F.col("comment_id").alias("id"), "body", "ups", "downs", "created_utc", "author",
        F.concat(F.lit("t3_"), "question_id").alias("link_id"), F.col("question_id").alias("link_id_clean"),
    )
    subs = stage(comments.select(F.col("question_id").alias("id")).distinct(), "ids")
    matched = threads.flat_comments(clean.matched_comments(links, subs))
    rows, split = _split_joins(profile.comment_content_stats(matched))
    assert split == 1 and rows[0]["ups_mean"] == 1


def test_prolific_comments(comments, small_thresholds):
    chosen = authors.prolific_comments(comments, 10, 255, 40)
    rows = chosen.select("author", "segment", F.md5("body"), F.spark_partition_id().alias("p")).collect()
    expected = authors.prolific_authors(comments, 10, 255).collect()
    assert Counter(r["author"] for r in rows) == {r["author"]: r["n_comments"] for r in expected}
    assert len({r["p"] for r in rows if r["author"] == "hot"}) > 3
    assert max(Counter((r["author"], r["segment"]) for r in rows).values()) < 80


def test_style_vectors_shuffle_text_once(comments, small_thresholds):
    chosen = authors.prolific_comments(comments, 10, 255, 40)
    vectors = inference.embed_authors(chosen, lambda: HashingEmbedder(8))
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    # Bodies are moved once, to their (author, segment), and nothing lies between that exchange and the model.
    assert below.count("hashpartitioning(author") == 1 and below.count("hashpartitioning(author#") == 1, below
    assert "segment" in below[below.index("hashpartitioning(author") :].split(")")[0], below
    model = HashingEmbedder(8)
    bodies = [r["body"] for r in comments.where("author = 'hot' and char_length(body) >= 255").collect()]
    hot = vectors.where("author = 'hot'").first()
    assert hot["num_comments_used"] == len(bodies)
    assert np.allclose(hot["embedding"], model(bodies).mean(axis=0), rtol=1e-5)


def test_oldest_answer(spark, comments, small_thresholds):
    ids = stage(comments.select(F.col("question_id").alias("id")).distinct(), "ids")
    names = stage(comments.select("author").distinct(), "names")
    found = answers.oldest_answer(answers.answer_candidates(comments, ids, names, 50))
    rows, split = _split_joins(found.select("question_id", "author", "comment_id", F.md5("body")))
    assert split == 2
    best = {}
    for r in sorted(comments.where("char_length(body) >= 50").collect(), key=lambda r: (r["created_utc"], r["comment_id"])):
        best.setdefault((r["question_id"], r["author"]), r["comment_id"])
    assert {(r["question_id"], r["author"]): r["comment_id"] for r in rows} == best


def test_crowded_thread_is_spread_over_segments(spark, comments, small_thresholds):
    links = comments.select(
        F.col("comment_id").alias("id"), "body", "ups", "downs", "created_utc", "author",
        F.concat(F.lit("t3_"), "question_id").alias("link_id"), F.col("question_id").alias("link_id_clean"),
    )
    subs = stage(comments.select(F.col("question_id").alias("id")).distinct(), "ids")
    nested = threads.assemble_threads(subs, links, 25)
    sizes = nested.select("id", F.array_size("top_level_comments").alias("n"), F.spark_partition_id().alias("p")).collect()
    hot = [r for r in sizes if r["id"] == "hot"]
    assert max(r["n"] for r in sizes) < 60 and len({r["p"] for r in hot}) > 3
    assert sum(r["n"] for r in sizes) == comments.count()


def test_pair_rows(spark, small_thresholds):
    vectors = spark.read.parquet(VECTORS)
    name = F.concat(F.lit("a"), F.col("vec_id").cast("string"))
    styles = stage(vectors.select(name.alias("author"), "embedding"), "styles")
    answers_ = stage(
        vectors.select(
            F.when(F.col("vec_id") % 3 == 0, "a0").otherwise(name).alias("author"),
            F.when(F.col("vec_id") % 3 == 1, "hot").otherwise(F.concat(F.lit("q"), (F.col("vec_id") % 9).cast("string"))).alias("question_id"),
            "vec_id",
            "embedding",
        ).repartition(12),
        "answers",
    )
    plan = sim.plan_pairs(answers_, styles, row_key=("vec_id",))
    rows, split = _split_joins(plan.rows().agg(F.count("*"), F.sum(F.col("embedding")[0] * F.col("style")[0])))
    assert split == 2 and rows[0][0] == answers_.count()
