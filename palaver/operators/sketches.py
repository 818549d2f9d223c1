"""Distinct authors from stored sketches: a new dump adds its own rows, and older ones are not counted again.

A sketch (HyperLogLog, 2^lg_k registers of one byte) stands for the authors of one part of one side. Sketches of any parts
are merged without a look at their rows. After a merge an estimate has a relative standard error of 1.04 / sqrt(2^lg_k);
``author_overlap_estimate`` states three of them as its bound. What is on both sides is the sum of the sides less their
union, so its bound is the sum of the three bounds: absolute, and wide where few authors of many are on both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.profile import side_by_side

#: Registers as a power of two, and standard errors within which an estimate is said to lie.
LG_K, ERRORS = 14, 3
ASKED, ANSWERED = "asked", "answered"


def relative_bound(lg_k: int = LG_K) -> float:
    """How far a merged estimate may lie from the truth, as a share of it."""
    return ERRORS * 1.04 / math.sqrt(1 << lg_k)


def author_sketches(submissions: DataFrame, comments: DataFrame, part: str, lg_k: int = LG_K) -> DataFrame:
    """(part, side, sketch) of each part of either input, as named by its column ``part``.

    Null authors are left out, a null part is a part. Rows are sketched before they are shuffled, so each task sends one
    sketch for a part, whatever the number of its rows.
    """
    rows = [df.select(F.col(part).alias("part"), F.lit(side).alias("side"), "author") for df, side in ((submissions, ASKED), (comments, ANSWERED))]
    return rows[0].unionByName(rows[1]).groupBy("part", "side").agg(F.hll_sketch_agg("author", F.lit(lg_k)).alias("sketch"))


def author_overlap_estimate(sketches: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Estimates of what ``author_overlap`` counts, each beside its bound, from the sketches of any parts.

    One row; without sketches all numbers are 0. Sketches must be of one size, ``lg_k``.
    """

    def merged(sketch: Column) -> Column:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0))

    sketch, side = F.col("sketch"), F.col("side")
    sums = sketches.agg(
        merged(F.when(side == ASKED, sketch)).alias("n_submission_authors"),
        merged(F.when(side == ANSWERED, sketch)).alias("n_comment_authors"),
        merged(sketch).alias("n_union"),
    )
    sizes = ["n_submission_authors", "n_comment_authors", "n_union"]
    total = F.col(sizes[0]) + F.col(sizes[1])
    both = F.least(F.greatest(total - F.col("n_union"), F.lit(0)), F.col(sizes[0]), F.col(sizes[1]))
    bounds = [(F.col(c) * relative_bound(lg_k)).alias(f"{c}_bound") for c in sizes]
    return sums.select(*sizes, both.alias("n_both"), *bounds, ((total + F.col("n_union")) * relative_bound(lg_k)).alias("n_both_bound"))


def estimate_beside_count(estimate: DataFrame, exact: DataFrame) -> DataFrame:
    """(measure, n, within) for each of the four numbers: the exact count, and whether the estimate's bound holds."""
    names = ["n_submission_authors", "n_comment_authors", "n_union", "n_both"]
    counted = exact.select(*[F.col(c).alias(f"{c}_exact") for c in names])
    rows = [
        F.struct(
            F.lit(c).alias("measure"),
            F.col(f"{c}_exact").alias("n"),
            (F.abs(F.col(c) - F.col(f"{c}_exact")) <= F.col(f"{c}_bound")).alias("within"),
        )
        for c in names
    ]
    return side_by_side(estimate, counted).select(F.inline(F.array(*rows)))
