"""Running totals that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.session import small_side, stage


def running_total(
    df: DataFrame,
    order: str,
    value: str,
    bucket: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``before`` (sum of ``value`` over smaller ``order``) and ``grand_total``.

    ``order`` must be unique. Two levels: totals per bucket are summed up over the short list
    of buckets, then each bucket is ordered by itself. ``bucket`` may be any expression that
    never falls as ``order`` rises; without one, rows are range-partitioned into ``buckets``
    parts and written to the shared folder, so that a repeated task sees the same ranges.
    """
    if bucket is None:
        parts = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = df.repartitionByRange(parts, F.col(order).asc_nulls_first())
        rows = stage(ranged.withColumn("_bucket", F.spark_partition_id()), "ranges")
        bound = parts
    else:
        rows = df.withColumn("_bucket", bucket)
        bound = None

    totals = rows.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket",
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(Window.partitionBy()).alias("grand_total"),
    )
    if bound is not None:
        offsets = small_side(offsets, bound)
    within = (
        Window.partitionBy("_bucket")
        .orderBy(F.col(order).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(offsets, "_bucket")
        .withColumn("before", F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_bucket", "_offset")
    )
