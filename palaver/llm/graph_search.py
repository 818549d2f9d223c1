"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Equal vectors are indexed once with their k+1 smallest ids, so that copies neither fill a shard nor hide each other.
Every distinct vector goes to the shard its hash names. Shards grow with the root of the table, up to 16 MB of vectors, and
the beam with the root of the shard, as each shard is asked about each query. In a shard, vectors enter in growing batches: a greedy search
on the graph so far proposes neighbours, relaxed distance pruning keeps a diverse few, edges are added both ways.
A beam search asks each shard; its results are scored in double precision on the original vectors and merged.

Rows whose id or vector is null, whose vector is empty, zero or holds a null or non-finite component take no part.
Only vectors of equal width meet. A repeated id among the queries is searched once (its smallest vector). Rows with
the query's own id are no candidates of it; a repeated row counts once. Equal scores go to the smaller id. An empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import finite_vectors, grid, pack_vectors, pair_blocks, unpack
from palaver.llm.exact_search import merge_top
from palaver.session import stage

#: Least vectors of a shard, out-edges of a vertex, width of the beam, and how much longer a detour may be than an edge.
SHARD_ROWS, DEGREE, BEAM, ALPHA = 4096, 24, 64, 1.2
QUERY_ROWS, BATCH = 512, 256
#: Shards hold this many times the root of the number of vectors, up to so many bytes of vectors.
SHARD_GROWTH, SHARD_BYTES = 16, 16 << 20
_SHARD = "block long, width int, ids binary, counts binary, vectors binary, edges binary, entry int"


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int):
    """Nearest vertices found for each query, nearest first, and their distances; x and q have length one."""
    b = len(q)
    rows = np.arange(b)
    ids = np.full((b, beam), -1)
    far = np.full((b, beam), np.inf, np.float32)
    ids[:, 0], far[:, 0] = entry, 1 - q @ x[entry]
    opened = np.zeros((b, beam), bool)
    seen = np.zeros((b, len(x)), bool)
    seen[:, entry] = True
    while True:
        ahead = np.where(opened | (ids < 0), np.inf, far)
        j = ahead.argmin(axis=1)
        live = np.flatnonzero(np.isfinite(ahead[rows, j]))
        if not len(live):
            return ids, far
        opened[live, j[live]] = True
        near = edges[ids[live, j[live]]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        row, slot = np.nonzero(near >= 0)
        seen[live[row], near[row, slot]] = True
        d = np.where(fresh, 1 - np.einsum("brd,bd->br", x[near], q[live]), np.inf).astype(np.float32)
        all_far = np.concatenate([far[live], d], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[live] = np.take_along_axis(all_far, order, axis=1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), order, axis=1)
        opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros(near.shape, bool)], axis=1), order, axis=1)
        ids[live] = np.where(np.isfinite(far[live]), ids[live], -1)


def robust_prune(x: np.ndarray, cand: np.ndarray, far: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates: the nearest, then the nearest that no kept one is alpha times nearer to, and so on."""
    order = np.argsort(far, axis=1, kind="stable")
    cand, far = np.take_along_axis(cand, order, axis=1), np.take_along_axis(far, order, axis=1)
    v = x[cand]
    between = 1 - v @ v.transpose(0, 2, 1)
    alive = np.isfinite(far)
    rows = np.arange(len(cand))
    kept = np.full((len(cand), degree), -1, np.int32)
    for slot in range(degree):
        j = alive.argmax(axis=1)
        has = alive[rows, j]
        if not has.any():
            break
        kept[has, slot] = cand[has, j[has]]
        alive &= alpha * alpha * between[rows, j] > far
        alive[rows, j] = False
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (row per vertex, -1 where none) and the entry vertex of a graph over unit vectors."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int32)
    entry = int((x @ x.mean(axis=0)).argmax())
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < n:
        new = order[done : done + min(BATCH, max(1, done // 2))]
        done += len(new)
        cand, far = beam_search(x, edges, entry, x[new], beam)
        edges[new] = robust_prune(x, cand, far, degree, alpha)
        source, slot = np.nonzero(edges[new] >= 0)
        target, source = edges[new][source, slot], new[source]
        d = 1 - np.einsum("ed,ed->e", x[target], x[source])
        by = np.lexsort((d, target))
        target, source, d = target[by], source[by], d[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        wide = min(int(count.max()), 2 * degree)  # nearest newcomers of a crowded vertex
        fit = place < wide
        extra = np.full((len(heads), wide), -1)
        extra_far = np.full((len(heads), wide), np.inf)
        row = np.repeat(np.arange(len(heads)), count)
        extra[row[fit], place[fit]], extra_far[row[fit], place[fit]] = source[fit], d[fit]
        old = edges[heads]
        old_far = np.where(old >= 0, 1 - np.einsum("hrd,hd->hr", x[old], x[heads]), np.inf)
        cand, far = np.concatenate([old, extra], axis=1), np.concatenate([old_far, extra_far], axis=1)
        full = (cand >= 0).sum(axis=1) > degree
        if full.any():
            edges[heads[full]] = robust_prune(x, cand[full], far[full].astype(np.float32), degree, alpha)
        if (~full).any():
            near = np.argsort(far[~full], axis=1, kind="stable")[:, :degree]
            some = np.take_along_axis(cand[~full], near, axis=1)
            edges[heads[~full]] = np.where(np.isfinite(np.take_along_axis(far[~full], near, axis=1)), some, -1)
    return edges, entry


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _build(key, rows):
    width = rows.column("width")[0].as_py()
    lists = rows.column("ids").combine_chunks()
    counts = np.asarray(lists.value_lengths()).astype(np.int32)
    vectors = np.asarray(rows.column("vector").combine_chunks().flatten()).reshape(-1, width)
    edges, entry = build_graph(_unit(vectors))
    return pa.table(
        {"block": [key[0].as_py()], "width": pa.array([width], pa.int32()), "ids": [np.asarray(lists.flatten()).tobytes()],
         "counts": [counts.tobytes()], "vectors": [vectors.tobytes()], "edges": [edges.tobytes()],
         "entry": pa.array([entry], pa.int32())}
    )


def grown_rows(vectors: int, width: int) -> int:
    """Vectors of a shard in an index of so many distinct ones."""
    most = SHARD_BYTES // (8 * max(1, width))
    return max(SHARD_ROWS, min(most, SHARD_GROWTH * math.isqrt(vectors)))


def graph_shards(
    candidates: DataFrame, keep: int, key: str, vector: str, shard_rows: int | None = None
) -> tuple[DataFrame, int, int]:
    """The index, a row for each shard with its distinct vectors, their smallest ids and the graph's edges; vectors a shard; widest vector."""
    c = finite_vectors(candidates, key, vector).where(F.exists("vector", lambda v: v != 0))
    smallest = Window.partitionBy("vector").orderBy("id")
    some = c.withColumn("place", F.dense_rank().over(smallest)).where(F.col("place") <= keep)
    distinct = stage(some.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids")), "vectors")
    n, widest = distinct.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    shard_rows = shard_rows or grown_rows(n, widest)
    shards = max(1, -(-n // shard_rows))
    dealt = distinct.select(
        F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("block"), F.size("vector").alias("width"), "ids", "vector"
    ).repartition(shards, "block", "width")
    return dealt.groupBy("block", "width").applyInArrow(_build, _SHARD), shard_rows, widest


def _ask(k: int, beam: int):
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                query_ids, query_vectors = unpack(row["query_ids"], row["query_vectors"], width)
                ids, vectors = unpack(row["ids"], row["vectors"], width)
                counts = np.frombuffer(row["counts"], np.int32)
                edges = np.frombuffer(row["edges"], np.int32).reshape(len(vectors), -1)
                found, _ = beam_search(_unit(vectors), edges, row["entry"], _unit(query_vectors), beam)
                q, slot = np.nonzero(found >= 0)
                v = found[q, slot]
                norm = lambda x: np.sqrt((x * x).sum(axis=1))
                score = (query_vectors[q] * vectors[v]).sum(axis=1) / (norm(query_vectors)[q] * norm(vectors)[v])
                n = counts[v]
                first = (np.cumsum(counts) - counts)[v]
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hit = pa.table(
                    {"query_id": np.repeat(query_ids[q], n), "part": pa.array(np.full(n.sum(), row["part"]), pa.int32()),
                     "vec_id": ids[at], "score": np.repeat(score, n)}
                ).to_pandas()
                hit = hit[hit["query_id"] != hit["vec_id"]]
                hit = hit.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                yield pa.RecordBatch.from_pandas(hit.groupby("query_id").head(k), preserve_index=False)

    return ask


def nearest(
    queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    shard_rows: int | None = None, beam: int | None = None,
) -> DataFrame:
    """Each query's k nearest found by cosine: query_id, rank, vec_id, score."""
    index, shard_rows, widest = graph_shards(candidates, k + 1, key, vector, shard_rows)
    shards = stage(index, "graph")
    beam = beam or round(BEAM * math.sqrt(max(1.0, shard_rows / SHARD_ROWS)))
    q = finite_vectors(queries, key, vector).where(F.exists("vector", lambda v: v != 0))
    q = q.groupBy("id").agg(F.min("vector").alias("vector"))
    n_queries = q.count()
    blocks = pack_vectors(q.repartition(max(1, -(-n_queries // QUERY_ROWS))), QUERY_ROWS)
    least = 2 * q.sparkSession.sparkContext.defaultParallelism
    pairs = pair_blocks(blocks, shards, *grid(n_queries, QUERY_ROWS, shards.count(), shard_rows, widest, least))
    return merge_top(pairs.mapInArrow(_ask(k, beam), "query_id long, part int, vec_id long, score double"), k)
