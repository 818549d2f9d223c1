"""Nested threads: one submission with its top-level comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators.segments import MAX_ROWS, plan_segments

COMMENT_FIELDS = ("id", "body", "ups", "downs", "created_utc", "author")


def assemble_threads(submissions: DataFrame, comments: DataFrame, max_comments_per_row: int = MAX_ROWS) -> DataFrame:
    """Submissions left-joined to the list of their comments, oldest first.

    A thread is one row with ``segment`` 0 unless it has more than ``max_comments_per_row``
    comments; then its ordered list is cut into several rows, which laid end to end are the list.
    Comments are ordered by time, unknown times first, then id.
    Threads without comments hold NULL. Pass ``comments`` as a stored table where it can be
    had: it is read once for counting (key column only) and once for nesting.

    The semi join, the nesting and the outer join all use (submission, segment), so comment
    bodies are shuffled once and a crowded thread is spread over as many tasks as segments.
    """
    named = comments.where(F.col("link_id").startswith("t3_"))
    segments = plan_segments(named, "link_id_clean", ("created_utc", "id"), max_comments_per_row)
    heads = segments.expand(submissions, "id")
    labelled = segments.label(named, "link_id_clean")

    keys = heads.select(F.col("id").alias("_sid"), F.col("segment").alias("_seg"))
    kept = labelled.join(
        keys, (F.col("link_id_clean") == F.col("_sid")) & (F.col("segment") == F.col("_seg")), "left_semi"
    )
    nested = kept.groupBy(F.col("link_id_clean").alias("_sid"), F.col("segment").alias("_seg")).agg(
        F.sort_array(
            F.collect_list(F.struct("created_utc", "id", F.struct(*COMMENT_FIELDS).alias("comment")))
        ).alias("_list")
    )
    return (
        heads.join(nested, (F.col("id") == F.col("_sid")) & (F.col("segment") == F.col("_seg")), "left")
        .withColumn("top_level_comments", F.transform("_list", lambda c: c["comment"]))
        # Where equal comments fill several segments, one may be empty; a thread's first row alone stands for "none".
        .where((F.col("segment") == 0) | F.col("_list").isNotNull())
        .select(*submissions.columns, "segment", "top_level_comments")
    )


def thread_heads(threads: DataFrame) -> DataFrame:
    """The submissions of stored threads, one row each."""
    return threads.where(F.col("segment") == 0).drop("segment", "top_level_comments")


def explode_comments(
    threads: DataFrame, keep_empty: bool = False, fields: tuple[str, ...] = COMMENT_FIELDS
) -> DataFrame:
    """Stored threads back to one row per comment: ``question_id`` and the chosen fields.

    The comment's ``id`` becomes ``comment_id``. With ``keep_empty`` a thread without comments
    gives one row of NULLs. A Parquet scan reads just ``fields``: they are taken out of the
    list before it is exploded, as the optimizer prunes below an explode only for one field.
    """
    unnest = F.explode_outer if keep_empty else F.explode
    if set(fields) == set(COMMENT_FIELDS):
        comments = F.col("top_level_comments")
    else:
        comments = F.arrays_zip(*(F.col(f"top_level_comments.{f}").alias(f) for f in fields))
    rows = threads.select(F.col("id").alias("question_id"), unnest(comments).alias("c"))
    return rows.select("question_id", *(F.col(f"c.{f}").alias("comment_id" if f == "id" else f) for f in fields))


def flat_comments(matched: DataFrame) -> DataFrame:
    """Matched comments in the columns of :func:`explode_comments`, without nesting them first."""
    return matched.select(
        F.col("link_id_clean").alias("question_id"),
        F.col("id").alias("comment_id"),
        "body",
        "ups",
        "downs",
        "created_utc",
        "author",
    )


def first_threads(submissions: DataFrame, comments: DataFrame, n: int = 2) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` submissions by id and their comments, so that a preview nests nothing else."""
    first = submissions.orderBy("id").limit(n)
    ids = first.select(F.col("id").alias("link_id_clean"))
    return first, comments.join(F.broadcast(ids), "link_id_clean", "left_semi").select(comments.columns)


def thread_preview(threads: DataFrame, n: int = 2) -> DataFrame:
    """The rows of the first ``n`` threads by id, for a look at the result."""
    ids = thread_heads(threads).select(F.col("id").alias("_sid")).orderBy("_sid").limit(n)
    own = threads.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("_sid")), "left_semi")
    return own.orderBy("id", "segment")
