"""Ordered cuts of crowded keys."""

import random

import pytest
from pyspark.sql import functions as F

from palaver.operators import segments


@pytest.mark.parametrize("stride", [2, 256])
@pytest.mark.parametrize("limit", [1, 3, 40])
def test_cuts_against_sorting(spark, monkeypatch, stride, limit):
    monkeypatch.setattr(segments, "_STRIDE", stride)
    rng = random.Random(limit)
    rows = [(rng.choice(["hot", "hot", "b", None, "c"]), rng.choice([None, 1, 2, 3]), f"r{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t bigint, id string").repartition(5)
    cut = segments.plan_segments(df, "k", ("t", "id"), limit)
    got = {(r["k"], r["id"]): r["segment"] for r in cut.label(df, "k").collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1], r[2]))
        for n, r in enumerate(mine):
            assert got[key, r[2]] == (0 if key is None else n // limit)
    names = spark.createDataFrame([("hot",), ("b",), ("none",)], "k string")
    parts = {r["k"]: r["n"] for r in cut.expand(names, "k").groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert parts == {k: max(1, -(-sum(r[0] == k for r in rows) // limit)) for k in ("hot", "b", "none")}


def test_equal_rows_are_spread_over_the_segments_they_fill(spark):
    df = spark.range(900).select(F.lit("hot").alias("k"), F.lit(5).alias("t"), F.lit("same").alias("id")).union(
        spark.range(20).select(F.lit("hot"), F.lit(1), F.col("id").cast("string"))
    )
    cut = segments.plan_segments(df, "k", ("t", "id"), 50)
    sizes = {r["segment"]: r["n"] for r in cut.label(df, "k").groupBy("segment").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 920 and max(sizes.values()) < 120 and len(sizes) >= 18
    first = cut.label(df, "k").where("t = 1").select("segment").distinct().collect()
    assert [r["segment"] for r in first] == [0]
