"""Authors with enough long comments, and their text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import min_chars
from palaver.operators.segments import segments_of_counts
from palaver.session import small_side, stage

# Default thresholds.
MIN_COMMENTS = 50
STYLE_MIN_CHARS = 255

#: Comments of one author that are handled together.
SEGMENT_ROWS = 2_000


def long_comments(comments: DataFrame, min_len: int = STYLE_MIN_CHARS) -> DataFrame:
    """Comments by a known author whose body has at least ``min_len`` characters."""
    return comments.where(min_chars(F.col("body"), min_len) & F.col("author").isNotNull())


def prolific_authors(
    comments: DataFrame, min_comments: int = MIN_COMMENTS, min_len: int = STYLE_MIN_CHARS
) -> DataFrame:
    """Authors with at least ``min_comments`` long comments: (author, n_comments)."""
    return (
        long_comments(comments, min_len)
        .groupBy("author")
        .agg(F.count(F.lit(1)).alias("n_comments"))
        .where(F.col("n_comments") >= min_comments)
    )


def prolific_comments(
    comments: DataFrame,
    min_comments: int = MIN_COMMENTS,
    min_len: int = STYLE_MIN_CHARS,
    max_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Long comments of prolific authors, each with the ``segment`` of its author it belongs to.

    An author has one segment per ``max_rows`` comments. Authors are counted first, so bodies
    stay out of any window, and the counts are written once: a short list is broadcast, and a
    long one meets the comments on (author, segment), which spreads a crowded author over
    tasks and leaves rows where the next step groups them.
    """
    counts = stage(prolific_authors(comments, min_comments, min_len), "prolific")
    long = long_comments(comments, min_len)
    segments = segments_of_counts(counts, "author", "n_comments", long, ("comment_id",), max_rows)
    names = segments.expand(counts, "author").select(F.col("author").alias("_name"), F.col("segment").alias("_seg"))
    labelled = segments.label(long, "author")
    return labelled.join(
        small_side(names, names.count()),
        (F.col("author") == F.col("_name")) & (F.col("segment") == F.col("_seg")),
        "left_semi",
    )


def author_bodies(
    comments: DataFrame,
    min_comments: int = MIN_COMMENTS,
    min_len: int = STYLE_MIN_CHARS,
    max_bodies_per_row: int = SEGMENT_ROWS,
) -> DataFrame:
    """Bodies per prolific author as lists of bounded length, in order of comment id: (author, segment, bodies).

    An author's segments laid end to end are the ordered list.

    Style vectors do not need it: they are summed up as the bodies are embedded.
    """
    kept = prolific_comments(comments, min_comments, min_len, max_bodies_per_row)
    return (
        kept.groupBy("author", "segment")
        .agg(F.sort_array(F.collect_list(F.struct("comment_id", "body"))).alias("_rows"))
        .select("author", "segment", F.transform("_rows", lambda r: r["body"]).alias("bodies"))
    )
