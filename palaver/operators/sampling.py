"""Repeatable samples: the rows with the smallest hash of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default seed and sizes.
SEED = 42
SAMPLE_ROWS = 10_000
EXAMPLES_PER_LABEL = 20

_PREFIX_DIGITS = 4


def sample_hash(row_id: Column, seed: int = SEED) -> Column:
    """A repeatable hash; a null id counts as an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))))


def sample_rows(df: DataFrame, id_col: str = "id", n: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all rows if there are fewer.

    The same rows come out whatever the partitioning. A first pass over the ids alone counts
    hash prefixes (at most 65,536 of them) and finds the prefix where ``n`` rows are reached;
    the final ordering then sees little more than ``n`` rows instead of ``n`` from each task.
    """
    hashed = df.withColumn("_hash", sample_hash(F.col(id_col), seed))
    prefix = F.substring("_hash", 1, _PREFIX_DIGITS)
    so_far = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cutoff = (
        hashed.groupBy(prefix.alias("_prefix"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_reached", F.sum("_n").over(so_far))
        .where(F.col("_reached") >= n)
        .agg(F.coalesce(F.min("_prefix"), F.lit("f" * _PREFIX_DIGITS)))
    )
    return hashed.where(prefix <= cutoff.scalar()).orderBy("_hash", F.asc_nulls_last(id_col)).limit(n).drop("_hash")


def sample_titles(submissions: DataFrame, n: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """Sample of (id, title) among submissions that have a title."""
    return sample_rows(submissions.where(F.col("title").isNotNull()).select("id", "title"), "id", n, seed)


def label_examples(
    classified: DataFrame, n: int = EXAMPLES_PER_LABEL, seed: int = SEED, id_col: str = "id"
) -> DataFrame:
    """Up to ``n`` sampled rows for each label; tasks send on at most ``n`` rows per label."""
    order = Window.partitionBy("label").orderBy("_hash", id_col)
    return (
        classified.withColumn("_hash", sample_hash(F.col(id_col), seed))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= n)
        .drop("_hash", "_rank")
    )
