"""Answers worth comparing: valid questions, styled authors, the oldest answer of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.labels import VALID
from palaver.functions.text import min_chars
from palaver.operators.segments import fresh_key

# Fixed value: default threshold.
ANSWER_MIN_CHARS = 250


def valid_questions(classified: DataFrame, label: str = VALID) -> DataFrame:
    """Distinct ids with the given label; the filter reaches the Parquet scan."""
    return classified.where(F.col("label") == label).select("id").distinct()


def answer_candidates(
    comments: DataFrame, questions: DataFrame, authors: DataFrame, min_len: int = ANSWER_MIN_CHARS
) -> DataFrame:
    """Long comments on the given questions (``id``) by the given authors (``author``).

    Both lists should be stored tables: their true size then decides whether they are
    broadcast, and a semi join needs no distinct, which would keep a crowded key from being split.
    """
    ids = questions.select(F.col("id").alias("_qid"))
    names = authors.select(F.col("author").alias("_name"))
    return (
        comments.where(F.col("body").isNotNull() & min_chars(F.col("body"), min_len))
        .join(ids, F.col("question_id") == F.col("_qid"), "left_semi")
        .join(names, F.col("author") == F.col("_name"), "left_semi")
        .select("question_id", "author", "body", "created_utc", "comment_id")
    )


def oldest_answer(candidates: DataFrame) -> DataFrame:
    """One answer per (question, author): the earliest, by comment id where times tie.

    A missing time counts as earliest. The rank filter is applied once before the shuffle
    too, so each task sends at most one row per pair, however often an author answered.
    """
    order = Window.partitionBy(fresh_key("question_id", "author")).orderBy(
        F.col("created_utc").asc_nulls_first(), F.col("comment_id").asc_nulls_first()
    )
    return candidates.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")
