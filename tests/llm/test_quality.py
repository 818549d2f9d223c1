"""The quality classifier: held-out accuracy, label discipline and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palaver.llm import quality, queries
from palaver.llm.common import text_buffer


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def drawn(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_scores_of_held_out_documents(spark, sf, docs, labels):
    rows = queries.queries()["op13_quality_classifier"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    said = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == drawn(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], said[r["doc_id"]]) for r in rows if r["held_out"] and said.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.9
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.9


def test_only_the_text_and_labels_that_may_be_read_count(spark, docs, labels):
    """Scores stay as they are when held-out labels are turned round and all other columns are lost."""
    some = quality.score_quality(docs, labels).toPandas().sort_values("id")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    bare = docs.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit("nowhere").alias("source"))
    other = quality.score_quality(bare, turned).toPandas().sort_values("id")
    assert np.allclose(some["score"], other["score"], atol=1e-9)


def test_scores_are_calibrated_by_a_temperature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 6))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.Network(x, y)
    fresh = rng.normal(size=(4000, 6))
    score, truth = net.score(fresh), 1 / (1 + np.exp(-2 * fresh[:, 0]))
    assert net.temperature > 0 and abs(score.mean() - truth.mean()) < 0.05
    assert np.mean(np.abs(score - truth)) < 0.12


def test_words_seen_nowhere_have_vectors_and_repeats_show():
    vectors = np.random.default_rng(1).normal(size=(quality.CELLS, 8)).astype(np.float32)
    texts = pa.array(["echo " * 50, "alpha bravo charlie delta", "", None, "w" * (quality.HELD + 10), "one\ttwo", "one two"])
    pooled = quality.pool(*text_buffer(texts), vectors)
    assert pooled.shape == (7, 16) and np.isfinite(pooled).all()
    assert np.isclose(pooled[0, 8:].sum(), 1, atol=1e-5)  # neighbours are equal: the products of unit vectors add up to one
    assert pooled[1, 8:].sum() < 0.9
    assert not pooled[2:4].any()
    assert np.allclose(pooled[5], pooled[6])


def test_parts_of_a_text_give_the_whole(monkeypatch):
    vectors = np.random.default_rng(1).normal(size=(quality.CELLS, 8)).astype(np.float32)
    texts = pa.array(["a few words of a text", "and of another, longer one " * 9, "short"])
    whole = quality.pool(*text_buffer(texts), vectors)
    monkeypatch.setattr(quality, "HELD", 16)
    assert np.allclose(quality.pool(*text_buffer(texts), vectors), whole, atol=1e-6)


def test_context_vectors_are_sums_over_all_rows(spark, docs, empty):
    few, many = quality.unit_vectors(docs.repartition(1)), quality.unit_vectors(docs.repartition(7))
    assert np.array_equal(few, many) and few.shape == (quality.CELLS, 2 * quality.WIDTH)
    assert not quality.unit_vectors(empty)[:, quality.WIDTH :].any()


def test_odd_rows(spark, odd, empty):
    told = spark.createDataFrame([(0, 1, 5), (1, 0, 5), (2, None, 5), (4, 0, 5), (5, 1, 5), (5, 0, 5), (9, 1, 5), (None, 1, 5), (77, 0, 5)], "doc_id long, quality int, text int")
    for labels in (told, told.where("false"), told.where("quality = 1")):
        rows = quality.score_quality(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.score_quality(odd, told.where("false")).collect()} == {0.5}
    assert quality.score_quality(empty, told).count() == 0
    same = quality.score_quality(odd, told).where("id in (0, 1)").select("score").distinct()
    assert same.count() == 1


def test_the_sample_is_a_share_of_the_rows(spark, docs):
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"), F.lit(1).alias("label"))
    vectors = np.zeros((quality.CELLS, 2 * quality.WIDTH), np.float32)
    assert quality.fit(rows, vectors, 10**12, sample=10**12 // 2).share == 1.0  # a sound share whatever the count
