"""Exact top-k search: tiles of queries by shards, partial selection in each tile, lists merged as a tree.

Components become floor(scale * x), so scores are integers and ties are exact. Rows whose id or vector is null,
whose vector is empty or holds a null or non-finite component take no part. Only vectors of equal width meet. A
repeated id among the queries is searched once (its smallest vector); repeated candidate rows count each; rows with
the query's own id are no candidates of it. Equal scores go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import finite_vectors, grid, pack_vectors, pair_blocks, top_mask, unpack

#: Rows of a shard's block and of a block of queries: a tile of scores takes 32 MB.
SHARD_ROWS, QUERY_ROWS = 4096, 1024
_TILE = "query_id long, part int, vec_id long, score long"


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors, exactly; values beyond 64 bits stay at the limit."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object)
    return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1).astype(np.int64)


def _search(k: int, scale: float):
    def tile(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = unpack(row["ids"], row["vectors"], row["width"])
                query_ids, query_vectors = unpack(row["query_ids"], row["query_vectors"], row["width"])
                scores = integer_products(np.floor(scale * query_vectors), np.floor(scale * vectors))
                own = query_ids[:, None] == ids[None, :]
                lowest = np.iinfo(np.int64).min
                mask = top_mask(np.where(own, lowest, scores), k) & ~own
                q, c = np.nonzero(mask)
                yield pa.RecordBatch.from_pydict(
                    {"query_id": query_ids[q], "part": pa.array(np.full(len(q), row["part"]), pa.int32()),
                     "vec_id": ids[c], "score": scores[q, c]}
                )

    return tile


def merge_top(found: DataFrame, k: int) -> DataFrame:
    """Best k of each query from partial lists: first within each group of shards, then over all groups."""
    for keys in (["query_id", "part"], ["query_id"]):
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def exact_top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    scale: float = 1024.0, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Each query's k best candidates: query_id, rank, vec_id, score."""
    q = finite_vectors(queries, key, vector).groupBy("id").agg(F.min("vector").alias("vector"))
    c = finite_vectors(candidates, key, vector)
    n_queries = q.count()
    n_rows, widest = c.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    q_blocks = pack_vectors(q.repartition(max(1, -(-n_queries // query_rows))), query_rows)
    least = 2 * q.sparkSession.sparkContext.defaultParallelism
    groups, slices = grid(n_queries, query_rows, -(-n_rows // shard_rows), shard_rows, widest, least)
    pairs = pair_blocks(q_blocks, pack_vectors(c, shard_rows), groups, slices)
    return merge_top(pairs.mapInArrow(_search(k, scale), _TILE), k)
