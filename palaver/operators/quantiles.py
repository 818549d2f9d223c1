"""Exact quantiles by radix selection on distinct values and their counts.

Rows collapse to (value, count) once. A rank's value is then found digit by digit: a pass counts the values by their next
``DIGIT_BITS`` bits, only inside the digits that hold a wanted rank, so that neither a task nor the driver ever sees more than
the radix's rows for each rank, whatever the range of the values. Integers are taken relative to the least one, so that a
narrow range needs a single pass and the whole bigint range four. Floating-point values are cut first by sign and exponent,
then into equal parts of the interval that holds the rank, until it holds one value.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.session import stage

#: Bits decided by one pass.
DIGIT_BITS = 16


def value_counts(df: DataFrame, col: str, *more: Column) -> DataFrame:
    """A stored table of the distinct values of a column, NULL among them, each with its number ``n`` of rows and ``more`` aggregates."""
    value = F.col(col)
    if isinstance(df.schema[col].dataType, T.IntegralType):
        value = value.cast("bigint")
    return stage(df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"), *more), "value-counts")


def _picked(digits: np.ndarray, counts: np.ndarray, rank: int) -> tuple[int, int]:
    """Where, in a list of digits with their counts, the one lies that holds a rank, and the rank within it."""
    ends = np.cumsum(counts)
    at = int(np.searchsorted(ends, rank, side="right"))
    return at, rank - int(ends[at] - counts[at])


def _integers(counts: DataFrame, low: int, high: int, ranks: list[int]) -> dict[int, int]:
    narrow = high - low < 1 << 63
    passes = max(1, -(-(high - low).bit_length() // DIGIT_BITS)) if narrow else 64 // DIGIT_BITS
    key = F.col("value") - F.lit(low) if narrow else F.col("value")
    rows = counts.select(key.alias("key"), "n")
    state = {rank: (None, rank) for rank in ranks}
    for step in range(passes - 1, -1, -1):
        head = F.shiftright("key", DIGIT_BITS * step)
        found = {h for h, _ in state.values()}
        inside = rows if None in found else rows.where(F.shiftright("key", DIGIT_BITS * (step + 1)).isin(sorted(found)))
        table = inside.groupBy(head.alias("head")).agg(F.sum("n").alias("n")).toArrow().sort_by("head")
        heads, sums = np.asarray(table.column("head")), np.asarray(table.column("n"))
        for rank, (prefix, left) in state.items():
            some = slice(None) if prefix is None else heads >> DIGIT_BITS == prefix
            at, left = _picked(heads[some], sums[some], left)
            state[rank] = (int(heads[some][at]), left)
    return {rank: h + (low if narrow else 0) for rank, (h, _) in state.items()}


def _exponent(value: Column) -> Column:
    """A number that never falls as a finite or infinite value rises: its sign and binary exponent."""
    size = F.when(F.abs(value) == F.lit(math.inf), 3000).when(value == 0, 0).otherwise(1100 + F.floor(F.log2(F.abs(value))))
    return (F.signum(value) * size).cast("int")


def _floats(counts: DataFrame, ranks: list[int]) -> dict[int, float]:
    summary = [F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")]
    found = {}
    table = counts.groupBy(_exponent(F.col("value")).alias("part")).agg(*summary).toArrow().sort_by("part").to_pylist()
    sums = np.array([r["n"] for r in table])
    todo = {}
    for rank in ranks:
        at, left = _picked(sums, sums, rank)
        todo[rank] = (table[at]["low"], table[at]["high"], left)
    while todo:
        found |= {rank: low for rank, (low, high, _) in todo.items() if low == high}
        todo = {rank: x for rank, x in todo.items() if rank not in found}
        for low, high in {x[:2] for x in todo.values()}:
            width = high - low
            part = F.least(F.floor((F.col("value") - low) / width * (1 << DIGIT_BITS)), F.lit((1 << DIGIT_BITS) - 1))
            inside = counts.where(F.col("value").between(low, high))
            table = inside.groupBy(part.alias("part")).agg(*summary).toArrow().sort_by("part").to_pylist()
            sums = np.array([r["n"] for r in table])
            for rank, (a, b, left) in todo.items():
                if (a, b) == (low, high):
                    at, left = _picked(sums, sums, left)
                    todo[rank] = (table[at]["low"], table[at]["high"], left)
    return found


def select_ranks(counts: DataFrame, ranks: set[int]) -> dict[int, float]:
    """The values at 0-based ``ranks`` among the rows of a stored :func:`value_counts` without NULLs."""
    if not ranks:
        return {}
    if isinstance(counts.schema["value"].dataType, T.FractionalType):
        return _floats(counts.where(~F.isnan("value")), sorted(ranks))
    low, high = counts.agg(F.min("value"), F.max("value")).first()
    return _integers(counts, low, high, sorted(ranks))


def quantiles_of_counts(counts: DataFrame, wanted: dict[str, tuple[float, str]]) -> dict[str, float | None]:
    """The same as :func:`exact_quantiles` from a stored :func:`value_counts`, as numbers."""
    known = counts.where(F.col("value").isNotNull())
    if isinstance(counts.schema["value"].dataType, T.FractionalType):
        known = known.where(~F.isnan("value"))
    n = known.agg(F.sum("n")).first()[0] or 0
    if not n:
        return dict.fromkeys(wanted)
    places = {}
    for name, (q, method) in wanted.items():
        position = (n - 1) * float(q)
        if method == "nearest":
            places[name] = (math.floor(position + 0.5),) * 2 + (0.0,)
        elif method == "linear":
            places[name] = (math.floor(position), math.ceil(position), position - math.floor(position))
        else:
            raise ValueError(f"unknown quantile method {method!r}")
    at = select_ranks(known, {r for low, high, _ in places.values() for r in (low, high)})
    value = lambda low, high, part: float(at[low]) + (float(at[high]) - float(at[low])) * part if part else float(at[low])
    return {name: value(*place) for name, place in places.items()}


def exact_quantiles(df: DataFrame, col: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """One row with a column per entry of ``wanted``: name -> (q, ``nearest`` or ``linear``).

    ``nearest`` takes the value at index ``floor((n-1)q + 0.5)``; ``linear`` interpolates
    between its neighbours. NULLs, and NaN among floats, are left out.
    """
    return one_row(df, quantiles_of_counts(value_counts(df, col), wanted))


def one_row(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Numbers as a table of one row."""
    spark = df.sparkSession
    return spark.range(1).select(*[F.lit(v).cast("double").alias(name) for name, v in values.items()])
