"""Cleaning of raw submissions and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions.text import from_fullname, lenient_bool, lenient_long

# Kept columns, marker texts and bot accounts.
SUBMISSION_COLUMNS = ("id", "title", "author", "created_utc", "over_18", "score", "num_comments")
COMMENT_COLUMNS = ("id", "body", "ups", "downs", "created_utc", "author", "parent_id", "link_id")
DELETED = "[deleted]"
REMOVED = "[removed]"
BOT_ACCOUNTS = (
    "AutoModerator",
    "RemindMeBot",
    "WikiTextBot",
    "ClickableLinkBot",
    "haiku_bot",
    "image_linker_bot",
    "sneakpeekbot",
)

RAW_SUBMISSION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in SUBMISSION_COLUMNS])
RAW_COMMENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COMMENT_COLUMNS])


def known_author(author: Column, denylist: tuple[str, ...] = BOT_ACCOUNTS) -> Column:
    """True for a present, undeleted account that is not on the list (case matters)."""
    return (author != DELETED) & ~author.isin(*denylist)


def drop_authors(df: DataFrame, col: str = "author", denylist: tuple[str, ...] = BOT_ACCOUNTS) -> DataFrame:
    return df.where(known_author(F.col(col), denylist))


def drop_removed(df: DataFrame, col: str = "body") -> DataFrame:
    return df.where((F.col(col) != DELETED) & (F.col(col) != REMOVED))


def top_level_only(df: DataFrame, col: str = "parent_id") -> DataFrame:
    """Keep comments whose parent is the submission itself."""
    return df.where(F.col(col).startswith("t3_"))


def clean_submissions(raw: DataFrame) -> DataFrame:
    return drop_authors(raw.select(*SUBMISSION_COLUMNS)).select(
        "id",
        "title",
        "author",
        lenient_long(F.col("created_utc")).alias("created_utc"),
        lenient_bool(F.col("over_18")).alias("over_18"),
        lenient_long(F.col("score")).alias("score"),
        lenient_long(F.col("num_comments")).alias("num_comments"),
    )


def clean_comments(raw: DataFrame) -> DataFrame:
    """Top-level comments by known authors, with ``link_id_clean`` naming the submission."""
    kept = raw.select(*COMMENT_COLUMNS).transform(top_level_only).transform(drop_removed).transform(drop_authors)
    return kept.select(
        "id",
        "body",
        lenient_long(F.col("ups")).alias("ups"),
        lenient_long(F.col("downs")).alias("downs"),
        lenient_long(F.col("created_utc")).alias("created_utc"),
        "author",
        "parent_id",
        "link_id",
        from_fullname(F.col("link_id")).alias("link_id_clean"),
    )


def matched_comments(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """Comments whose submission was kept.

    A semi join, so each row appears once however often an id is listed. A crowded submission
    is split over tasks by adaptive skew handling; a small id list is broadcast by its size.
    """
    # The link must be a full submission name, so a bare id never matches.
    ids = submissions.select(F.col("id").alias("_sid"))
    return comments.where(F.col("link_id").startswith("t3_")).join(
        ids, F.col("link_id_clean") == F.col("_sid"), "left_semi"
    )
