"""Both searches beside brute force in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import common, exact_search, graph_search


@pytest.fixture(scope="module")
def vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    again = df.where("vec_id < 40").select((F.col("vec_id") + 10_000).alias("vec_id"), "embedding")
    many = df.where("vec_id = 3").select(F.explode(F.sequence(F.lit(20_000).cast("long"), F.lit(20_060).cast("long"))).alias("vec_id"), "embedding")
    odd = spark.createDataFrame(
        [(50, None), (30_000, [0.0] * 64), (30_001, [float("nan")] * 64), (30_002, [None] + [1.0] * 63), (30_003, []), (None, [1.0] * 64),
         (30_050, [1.0, 2.0]), (30_100, [2.0, 1.0]), (30_004, [float("inf")] * 64)],
        "vec_id long, embedding array<double>",
    )
    return df.where("vec_id <> 50").union(again).union(many).union(odd).withColumns({"id": F.lit("x"), "vector": F.lit(1), "part": F.lit(2)})


def plain(df, step, k, score, zero):
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.vec_id is not None and r.embedding]
    rows = [(i, np.array(v)) for i, v in rows if all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    out = set()
    for q, a in rows:
        if q % step:
            continue
        found = sorted((-score(a, b), c) for c, b in rows if c != q and len(a) == len(b))[:k]
        out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(found)}
    return out


def product(a, b):
    return int(np.floor(1024 * a) @ np.floor(1024 * b))


def cosine(a, b):
    norm = lambda x: np.sqrt((x * x).sum())
    return (a * b).sum() / (norm(a) * norm(b))


@pytest.mark.parametrize("rows", [64, 4096])
def test_exact_top_k(vectors, rows):
    got = exact_search.exact_top_k(vectors.where("vec_id % 100 = 0"), vectors, shard_rows=rows, query_rows=3)
    assert {tuple(r) for r in got.collect()} == plain(vectors, 100, 10, product, True)


def test_large_components_stay_exact(spark):
    rows = [(0, [1e9, 3.0]), (1, [1e9, 1.0]), (2, [1e9 + 1, -5.0]), (3, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in exact_search.exact_top_k(df.where("vec_id = 0"), df, scale=1.0).collect()]
    exact = {i: min(int(1e9) * int(v[0]) + 3 * int(v[1]), 2**63 - 1) for i, v in rows if i}
    assert got == [(0, n + 1, i, exact[i]) for n, i in enumerate(sorted(exact, key=lambda i: -exact[i]))]


@pytest.mark.parametrize("rows", [100, 4096])
def test_graph_recall(vectors, rows):
    got = {tuple(r)[:1] + tuple(r)[2:3]: r for r in graph_search.nearest(vectors.where("vec_id % 50 = 0"), vectors, shard_rows=rows).collect()}
    wanted = plain(vectors, 50, 5, cosine, False)
    hits = [(q, c) for q, _, c, _ in wanted if (q, c) in got]
    assert len(hits) >= 0.97 * len(wanted) and len(got) == len(wanted)
    for q, _, c, s in wanted:
        if (q, c) in got:
            assert abs(got[q, c].score - s) < 1e-12


def test_each_pair_of_blocks_meets_once(vectors, monkeypatch):
    """Many groups and slices give what one task gives."""
    monkeypatch.setattr(common, "TASK_PAIRS", 1)
    queries = vectors.where("vec_id % 100 = 0")
    assert min(common.grid(20, 3, 40, 64, 64, 1)) > 1
    got = exact_search.exact_top_k(queries, vectors, shard_rows=64, query_rows=3)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(vectors, 100, 10, product, True))


@pytest.mark.parametrize("queries", [1, 1026, 200_000, 20_000_000])
@pytest.mark.parametrize("shards", [0, 1, 13, 200, 30_000])
def test_grid_of_tasks(queries, shards):
    groups, slices = common.grid(queries, 512, shards, 4096, 64, 12)
    blocks = -(-queries // 512)
    assert 1 <= groups <= max(1, shards) and 1 <= slices <= blocks
    assert min(12, max(1, shards) * blocks) <= groups * slices <= max(12, 2 * common.MOST_TASKS)
    assert blocks * 512 * 64 * 8 <= slices * common.SLICE_BYTES


@pytest.mark.parametrize("vectors, less", [(10**7, 4), (10**8, 7), (10**9, 60)])
def test_moved_rows_stay_far_below_a_copy_of_the_queries_for_each_shard(vectors, less):
    """Queries are a fiftieth of the vectors; the comparison is with shards of the least size, each sent every query."""
    rows = graph_search.grown_rows(vectors, 64)
    groups, slices = common.grid(vectors // 50, 512, vectors // rows, rows, 64, 12)
    assert less * (groups * (vectors // 50) + slices * vectors) < (vectors // 4096) * (vectors // 50) + vectors


def test_shards_grow_within_a_bound():
    assert graph_search.grown_rows(0, 0) == graph_search.grown_rows(60_000, 64) == 4096
    assert graph_search.grown_rows(10**6, 64) == 16_000
    assert graph_search.grown_rows(10**9, 64) == 32_768 and graph_search.grown_rows(10**9, 1024) == 4096


def test_recall_of_a_grown_shard():
    """Directions without any structure, the hardest case, in a shard of twice the least size, with the beam it gets."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8192, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    edges, entry = graph_search.build_graph(x)
    at = np.arange(0, 8192, 64)
    found, _ = graph_search.beam_search(x, edges, entry, x[at], round(graph_search.BEAM * 2**0.5))
    score = x[at] @ x.T
    score[np.arange(len(at)), at] = -2
    best = np.argsort(-score, axis=1)[:, :5]
    assert np.mean([len(set(f[f != q][:5]) & set(b)) / 5 for f, q, b in zip(found, at, best)]) >= 0.92


def test_empty(vectors):
    none = vectors.where("false")
    for search in (exact_search.exact_top_k, graph_search.nearest):
        assert search(none, none).count() == 0
        assert search(none, vectors).count() == 0
        assert search(vectors, none).count() == 0
