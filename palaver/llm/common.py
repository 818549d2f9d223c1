"""Helpers shared by the operators: text as bytes, words as spans and hashes, vectors as blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into arrays at a time; an array of one word per byte is eight times that.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(df: DataFrame, name: str) -> Column:
    """The text as UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row begins; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        _, at = text_buffer(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs free of blank, tab, line and page breaks) as byte spans; ``first[d]`` is the first word of row d."""
    solid = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], solid])
    after = np.concatenate([solid, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def follow(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit number for an ordered pair of 64-bit numbers."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


_BASE = 0x5851F42D4C957F2D
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        most = max(n, BLOCK_BYTES + 1)
        bases = (_BASE, pow(_BASE, -1, 1 << 64))
        _POWERS[:] = [
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(most - 1, b, np.uint64)])) for b in bases
        ]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes with A-Z in lower case, from running sums: no loop over words."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def finite_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id long, vector array<double>) of the rows that hold an id and a vector of finite numbers."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.where(F.col(key).isNotNull() & (F.size(F.col(vector)) > 0) & sound).select(
        F.col(key).cast("long").alias("id"), v.alias("vector")
    )


BLOCK_SCHEMA = "block long, width int, ids binary, vectors binary"


def pack_vectors(df: DataFrame, rows: int) -> DataFrame:
    """Rows (id, vector) as blocks of at most ``rows`` vectors of one width, in order of id; no shuffle."""

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def block(width):
            nonlocal number
            ids = np.concatenate([x[0] for x in held[width]])
            vectors = np.concatenate([x[1] for x in held[width]])
            del held[width]
            for begin in range(0, len(ids), rows):
                some, part = ids[begin : begin + rows], vectors[begin : begin + rows]
                order = np.argsort(some, kind="stable")
                number += 1
                yield pa.RecordBatch.from_pydict(
                    {"block": [number], "width": pa.array([width], pa.int32()), "ids": [some[order].tobytes()],
                     "vectors": [np.ascontiguousarray(part[order]).tobytes()]}
                )

        for batch in batches:
            ids = np.asarray(batch.column("id"))
            lists = batch.column("vector")
            lengths = np.asarray(lists.value_lengths())
            values = np.asarray(lists.flatten())
            ends = np.cumsum(lengths)
            for width in np.unique(lengths):
                mine = np.flatnonzero(lengths == width)
                at = (ends[mine] - width)[:, None] + np.arange(width)
                held.setdefault(int(width), []).append((ids[mine], values[at]))
                if sum(len(x[0]) for x in held[int(width)]) >= rows:
                    yield from block(int(width))
        for width in list(held):
            yield from block(width)

    return df.mapInArrow(pack, BLOCK_SCHEMA)


def unpack(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, width)


#: Pairs of a query block and a shard in a task, about; tasks of a search, about, at most; bytes of queries that a task holds.
TASK_PAIRS, MOST_TASKS, SLICE_BYTES = 256, 50_000, 256 << 20


def grid(queries: int, query_rows: int, shards: int, shard_rows: int, width: int, least: int) -> tuple[int, int]:
    """Groups of shards and slices of query blocks: a task for each group and slice, ``least`` tasks if there is work for them.

    A query block is moved once for each group and a shard once for each slice. Their numbers are chosen to move the fewest
    rows, so that what is moved grows with the root of the number of tasks, not with the number of shards. ``width`` is that of
    the widest vectors; it sets how many blocks a slice may hold.
    """
    shards, blocks = max(1, shards), max(1, -(-queries // query_rows))
    pairs = shards * blocks
    tasks = max(min(pairs, least), min(MOST_TASKS, -(-pairs // TASK_PAIRS)))
    groups = min(shards, max(1, round(math.sqrt(tasks * shards * shard_rows / max(1, queries)))))
    held = max(1, SLICE_BYTES // (8 * query_rows * max(1, width)))
    slices = min(blocks, max(-(-tasks // groups), -(-blocks // held)))
    return min(groups, -(-tasks // slices)), slices


def pair_blocks(queries: DataFrame, shards: DataFrame, groups: int, slices: int = 1) -> DataFrame:
    """Each shard row beside each query block of its width, once; ``part`` is the shard's group.

    Shards are dealt into ``groups``, the blocks of the queries, a stated query set, into ``slices``.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    q = queries.select(
        every(groups).alias("part"), dealt(slices).alias("slice"),
        "width", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"),
    )
    s = shards.withColumn("part", dealt(groups)).withColumn("slice", every(slices))
    keys = ["part", "slice", "width"]
    return s.repartition(groups * slices, *keys).join(q.repartition(groups * slices, *keys), keys)


def top_mask(scores: np.ndarray, k: int) -> np.ndarray:
    """Marks the k largest of each row, ties to the earlier column."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    above = scores > least
    ties = scores == least
    return above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)))
