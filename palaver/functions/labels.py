"""Prompt rendering and label parsing for question classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM_PROMPT = (
    "Decide what kind of answer a forum question asks for. "
    "Say Valid if it asks for an opinion, a belief or a judgement. "
    "Say Invalid if it asks for a story from someone's own life, for a fact, for advice, "
    "or whether others do the same. Reply with that one word and nothing else."
)

# The user message, and what is stripped from a completion before it is read.
USER_TEMPLATE = 'Question: "%s"'
STRIP_PATTERN = r"[^\p{L}\p{N}_\s]"
VALID, INVALID = "Valid", "Invalid"


def render_prompt(title: Column, system_prompt: str = SYSTEM_PROMPT) -> Column:
    """Chat messages asking for one title's label: array of (role, content)."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), F.format_string(USER_TEMPLATE, title).alias("content")),
    )


def parse_label(completion: Column) -> Column:
    """``Invalid`` if the cleaned completion mentions it, else ``Valid`` likewise, else NULL."""
    cleaned = F.lower(F.trim(F.regexp_replace(completion, STRIP_PATTERN, "")))
    return F.when(cleaned.contains("invalid"), INVALID).when(cleaned.contains("valid"), VALID)
