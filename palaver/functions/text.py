"""Lenient typing, kind prefixes and text measures as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain decimal numbers, and the prefix that marks a submission.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SUBMISSION_PREFIX = "t3_"


def lenient_long(col: Column) -> Column:
    """Text to bigint: decimals are cut towards zero, anything unreadable is NULL."""
    return F.when(col.rlike(NUMBER_PATTERN), col.try_cast("double").try_cast("bigint"))


def lenient_bool(col: Column) -> Column:
    """Exactly ``true`` is true; everything else, NULL too, is false."""
    return F.coalesce(col == "true", F.lit(False))


def to_fullname(col: Column, prefix: str = SUBMISSION_PREFIX) -> Column:
    """Put the kind prefix in front of an id."""
    return F.concat(F.lit(prefix), col)


def from_fullname(col: Column, prefix: str = SUBMISSION_PREFIX) -> Column:
    """Take one leading kind prefix off, if there is one."""
    return F.when(col.startswith(prefix), F.substring(col, len(prefix) + 1, 2147483647)).otherwise(col)


def min_chars(col: Column, n: int) -> Column:
    """At least ``n`` code points long."""
    return F.char_length(col) >= n


def hash_bucket(col: Column, buckets: Column | int) -> Column:
    """A repeatable bucket in ``[0, buckets)`` from the md5 of a text column."""
    n = buckets if isinstance(buckets, Column) else F.lit(buckets)
    return F.pmod(F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint"), n.cast("bigint")).cast("int")


def utc_text(epoch: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session time zone is."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (origin + F.make_dt_interval(secs=epoch.cast("decimal(18,6)"))).cast("string")
