"""Bounded lists: nest rows under a key without ever building one list for a crowded key.

A key with at most ``max_rows`` rows gets one list. The rows of a larger one are numbered in their order, and every
``max_rows`` of them are a segment, which is a row of its own: segments laid end to end are the ordered list. Only keys and
order columns of crowded keys are ranked, on two levels (ranges of rows, then rows of a range), so no task sorts a
crowded key by itself. What is kept of the ranking are the cuts, the first row of each segment; rows find their
segment among their key's cuts, so the wide rows are not moved for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.session import small_side, stage

MAX_ROWS = 10_000
#: Cuts that are looked through at a time: first every so many of them, then those between two.
_STRIDE = 256


def fresh_key(*cols: str) -> Column:
    """The columns as one composite key.

    Grouping by it shuffles partial results anew instead of leaning on the partitioning a
    join left behind. The extra exchange carries little, and it leaves adaptive execution
    free to split the join where one of its keys is crowded.
    """
    return F.struct(*cols)


@dataclass(frozen=True)
class Segmentation:
    """The cuts of each crowded key, in order; keys not listed have one segment."""

    crowded: DataFrame | None
    n_cuts: int
    order: tuple[str, ...]

    def _attach(self, df: DataFrame, key: str) -> DataFrame:
        crowded = small_side(self.crowded, self.n_cuts)
        return df.join(crowded, df[key] == crowded["_crowded_key"], "left").drop("_crowded_key")

    def label(self, df: DataFrame, key: str) -> DataFrame:
        """Give each row its ``segment``.

        Rows that are equal in their order are spread evenly over the segments that begin with such a row; a segment can
        pass the limit only by rows that are equal to its first.
        """
        if self.crowded is None:
            return df.withColumn("segment", F.lit(0))
        own = _place(self.order)
        steps = F.filter("_cuts", lambda _, i: i % _STRIDE == 0)

        def before(equal: bool) -> Column:
            """How many cuts lie before the row, or at it."""
            counts = lambda cuts: F.size(F.filter(cuts, lambda c: c <= own if equal else c < own))
            start = F.greatest(counts(F.col("_steps")) - 1, F.lit(0)) * _STRIDE
            return start + counts(F.slice("_cuts", start + 1, F.lit(_STRIDE)))

        last = F.greatest(before(True) - 1, F.lit(0))
        first = F.least(before(False), last)  # the first segment that begins with an equal row
        spread = F.when(first == last, last).otherwise(first + F.floor(F.rand(7) * (last - first + 1)).cast("int"))
        labelled = self._attach(df, key).withColumn("_steps", steps)
        segment = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(spread)
        return labelled.withColumn("segment", segment.cast("int")).drop("_cuts", "_steps")

    def expand(self, df: DataFrame, key: str) -> DataFrame:
        """Repeat each row once per segment of its key."""
        if self.crowded is None:
            return df.withColumn("segment", F.lit(0))
        last = F.coalesce(F.array_size("_cuts"), F.lit(1)) - 1
        return self._attach(df, key).withColumn("segment", F.explode(F.sequence(F.lit(0), last))).drop("_cuts")


def _place(order: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


def plan_segments(df: DataFrame, key: str, order: tuple[str, ...], max_rows: int = MAX_ROWS) -> Segmentation:
    """Count rows per key and cut only the keys that need more than one segment.

    The count is pre-aggregated before its shuffle and reads the key column only.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return segments_of_counts(counts, key, "_n", df, order, max_rows)


def segments_of_counts(
    counts: DataFrame, key: str, n: str, rows: DataFrame, order: tuple[str, ...], max_rows: int = MAX_ROWS
) -> Segmentation:
    """The same from rows per key that are known already; ``rows`` are the rows that were counted.

    The cuts of crowded keys are written to the shared folder, so that later uses do not rank again. NULLs come first.
    """
    names = counts.where(F.col(n) > max_rows).select(F.col(key).alias("_crowded_key"))
    names = stage(names, "crowded")
    n_names = names.count()
    if not n_names:
        return Segmentation(None, 0, order)
    crowded = rows.join(small_side(names, n_names), F.col(key) == F.col("_crowded_key"))
    narrow = crowded.select("_crowded_key", *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    by = [f"o{i}" for i in range(len(order))]
    ranges = stage(narrow.repartitionByRange("_crowded_key", *by).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_crowded_key", "_range").agg(F.count(F.lit(1)).alias("_size"))
    ahead = Window.partitionBy("_crowded_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_crowded_key", "_range", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"))
    number = F.row_number().over(Window.partitionBy("_crowded_key", "_range").orderBy(*by))
    numbered = ranges.withColumn("_number", number).join(offsets, ["_crowded_key", "_range"])
    rank = F.col("_ahead") + F.col("_number") - 1
    firsts = numbered.where(rank % max_rows == 0).select("_crowded_key", F.struct(*by).alias("cut"))
    cuts = stage(firsts.groupBy("_crowded_key").agg(F.sort_array(F.collect_list("cut")).alias("_cuts")), "cuts")
    n_cuts = cuts.agg(F.sum(F.size("_cuts"))).first()[0]
    return Segmentation(cuts, n_cuts, order)
