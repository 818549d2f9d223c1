"""Shards of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, id, a hash of the record's place in the input), so equal texts lie together. A size-weighted sample of these keys gives
splitters at equal shares of the bytes; records are range-partitioned by them, exact bytes are counted, and ranges that
turn out overfull are subdivided by splitters of a denser sample, until none is. Because the key ends in the id and the place, a
group of copies with a third of all rows is many ranges, even if all have one id. Range totals give each range its place in the whole, running
sums within a range give each record its place, and that names the shard. Copies stay in one shard where their bytes
are under a hundredth of a shard's; larger groups are cut at shard ends. Only narrow rows (key, id, size) are shuffled.

Null texts have size 1. A record with a null id comes first among its copies. Records that are equal in text and id
are ordered by their place but get different slots. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import text_column
from palaver.session import stage

#: Least and most ranges, records aimed at in each, sampled keys for each, and times the mean bytes that is overfull.
RANGES, MOST_RANGES, RANGE_ROWS, KEYS_PER_RANGE, OVERFULL = 512, 65_536, 1_000_000, 32, 4
#: Share of a shard's bytes up to which a group of copies is kept whole.
WHOLE = 0.01


_KEY = ["key", "id", "place"]


def _ordered(*columns: np.ndarray) -> np.ndarray:
    """Keys as 24 bytes that sort like them."""
    flip = np.uint64(1 << 63)
    every = np.stack([c.astype(np.int64).view(np.uint64) ^ flip for c in columns], axis=1)
    return np.ascontiguousarray(every.astype(">u8")).view("S24").ravel()


def _places(cuts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many of the sorted cuts lie at or before each key."""
    if not len(cuts):
        return np.zeros(len(keys), np.int32)
    order = np.argsort(np.concatenate([cuts, keys]), kind="stable")  # cuts come before equal keys
    ahead = np.cumsum(order < len(cuts))
    out = np.empty(len(order), np.int32)
    out[order] = ahead
    return out[len(cuts) :]


def sample_splitters(rows: DataFrame, ranges: int, total: int, per_range: int, seed: int) -> list[tuple[int, int, int]]:
    """Keys that cut the bytes into about equal ranges.

    A record is drawn with a probability in proportion to its size, by a hash of its key, so a task that is run again
    draws the same. About ``ranges * per_range`` keys come to the driver, whatever the table's size.
    """
    goal = max(1, ranges * per_range)
    share = F.lit(float(goal)) * F.col("size") / F.lit(float(max(1, total)))
    lot = F.pmod(F.xxhash64(F.lit(seed), *_KEY, "size"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(lot < share).select(*_KEY, F.greatest(F.col("size"), F.lit(total / goal)).alias("weight"))
    some = drawn.toPandas().sort_values(_KEY, kind="stable")
    if some.empty:
        return []
    shares = some["weight"].cumsum().to_numpy() / some["weight"].sum()
    at = np.unique(np.searchsorted(shares, np.arange(1, ranges) / ranges))
    return sorted({tuple(map(int, r)) for r in zip(*(some[c].to_numpy()[at] for c in _KEY))})


def with_range(rows: DataFrame, splitters: list[tuple[int, int, int]]) -> DataFrame:
    """Adds the number of the range that a record's key lies in."""
    cuts = _ordered(*np.array(splitters or [(0, 0, 0)], np.int64).T)[: len(splitters)]

    @F.pandas_udf("int")
    def find(key: pd.Series, own: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(_places(cuts, _ordered(key.to_numpy(), own.to_numpy(), place.to_numpy())))

    return rows.withColumn("range", find(*_KEY))


def _refined(rows: DataFrame, splitters: list, sizes: dict[int, int], limit: float) -> list:
    """More splitters inside the ranges that hold more than ``limit`` bytes."""
    over = {r: b for r, b in sizes.items() if b > limit}
    more = set(splitters)
    crowded = with_range(rows, splitters).where(F.col("range").isin(list(over))).drop("range")
    parts = int(2 * sum(over.values()) / limit) + 2
    for cut in sample_splitters(crowded, parts, sum(over.values()), KEYS_PER_RANGE, seed=len(splitters)):
        more.add(cut)
    return sorted(more)


def assign_shards(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each record: id, size, text_crc32, shard and its slot there (gapless from 0)."""
    return _assigned(_records(df, key, text), shards).drop("key", "place")


def _records(df: DataFrame, key: str, text: str, at: Column | None = None) -> DataFrame:
    """The narrow rows that are sorted, with a hash of the record's place ``at``, a number that differs for all of them."""
    data = text_column(df, text)
    return df.select(
        F.col(key).cast("long").alias("named"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"),
        (F.octet_length(data) + F.lit(1)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("key"),
        F.xxhash64(F.monotonically_increasing_id() if at is None else at).alias("place"),
    )


def _assigned(rows: DataFrame, shards: int) -> DataFrame:
    rows = stage(rows, "records")
    n, total, largest = (x or 0 for x in rows.agg(F.count("*"), F.sum("size"), F.max("size")).first())
    goal = min(MOST_RANGES, max(RANGES, n // RANGE_ROWS))
    splitters = sample_splitters(rows, goal, total, KEYS_PER_RANGE, seed=0)
    limit = OVERFULL * total / goal
    for _ in range(4):
        counts = with_range(rows, splitters).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        sizes = {r["range"]: r["bytes"] for r in counts.collect()}  # one row for each range
        if all(b <= max(limit, 2 * largest) for b in sizes.values()):
            break
        finer = _refined(rows, splitters, sizes, limit)
        if finer == splitters:
            break
        splitters = finer
    ranges = len(splitters) + 1
    placed = with_range(rows, splitters).repartition(max(1, min(ranges, max(64, ranges // 4))), "range")
    order = Window.partitionBy("range").orderBy(*_KEY)
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = stage(placed.withColumn("ahead", F.coalesce(before, F.lit(0))), "ranges")

    groups = placed.groupBy("range", "key").agg(F.min("ahead").alias("group_ahead"), F.sum("size").alias("group_size"))
    edges = groups.groupBy("range").agg(F.sum("group_size").alias("bytes"))
    offsets = edges.select(
        "range", F.coalesce(F.sum("bytes").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    share = F.lit(float(shards)) / F.lit(float(max(1, total)))
    at = lambda c: F.least(F.floor(c * share), F.lit(shards - 1)).cast("int")
    # A group that no range end cuts begins and ends in one range; the first and last group of a range may go on.
    whole = groups.groupBy("key").agg(
        F.count("*").alias("pieces"), F.sum("group_size").alias("all"), F.min("range").alias("range"), F.min_by("group_ahead", "range").alias("group_ahead")
    ).where(F.col("all") * share <= F.lit(WHOLE))
    whole = whole.where(F.col("all") > 0).join(F.broadcast(offsets), "range")
    whole = whole.select("key", at(F.col("base") + F.col("group_ahead") + F.col("all") / 2).alias("own_shard"))
    # A group meets its copies range by range, so that one in many ranges is many keys of the join.
    whole = groups.select("range", "key").join(whole, "key")
    named = placed.join(F.broadcast(offsets), "range").join(whole, ["range", "key"], "left")
    named = named.select(
        "named", *_KEY, "size", "text_crc32", "range",
        F.coalesce("own_shard", at(F.col("base") + F.col("ahead") + F.col("size") / 2)).alias("shard"),
    )
    named = stage(named, "shards")
    counts = named.groupBy("range", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range", "shard").orderBy(*_KEY)) - 1
    return named.withColumn("inside", inside).join(F.broadcast(starts), ["range", "shard"]).select(
        F.col("named").alias("id"), "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"), "key", "place"
    )


def write_shards(df: DataFrame, path: str, shards: int = 16, key: str = "doc_id", text: str = "text") -> None:
    """Writes the records themselves, one folder for each shard, rows in the order of their slots within a file.

    Every record is written once, repeated rows and null ids too: records are stored with their places first, and
    joined by place, which differs for all of them. Columns ``shard`` and ``slot`` of the input are replaced.
    """
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole")
    stored = stage(df.select(whole, F.monotonically_increasing_id().alias("at")), "whole")
    rows = stored.select(F.col(f"whole.`{key}`").alias("k"), F.col(f"whole.`{text}`").alias("t"), "at")
    placed = _assigned(_records(rows, "k", "t", F.col("at")), shards).select("place", "shard", "slot")
    joined = stored.withColumn("place", F.xxhash64("at")).join(placed, "place").repartition("shard", F.floor(F.col("slot") / 100_000))
    joined.sortWithinPartitions("shard", "slot").select("whole.*", "shard", "slot").write.partitionBy("shard").parquet(path)
