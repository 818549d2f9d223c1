"""Archive links found in HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Archive name pattern and the communities left out by default.
ARCHIVE_SUFFIX = ".zst"
ARCHIVE_PATTERN = r"(?i)^.*/([^/]+)_(submissions|comments)\.zst$"
EXCLUDED_NAMES = (
    "AskReddit",
    "politics",
    "worldnews",
    "AmItheAsshole",
    "brasil",
    "Tinder",
    "AMA",
    "AskRedditAfterDark",
    "geopolitics",
    "anime_titties",
    "SeriousConversation",
)

COMMENT_PATTERN = r"(?s)<!--.*?-->"
SCRIPT_PATTERN = r"(?is)<script\b.*?</script\s*>"
# Attributes before the address may be quoted, and a quoted value may hold any character.
HREF_PATTERN = r"""(?is)<a\s(?:(?:"[^"]*"|'[^']*'|[^>"'])*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
NUMERIC_REFERENCE = r"(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"


def visible_html(html: Column) -> Column:
    """HTML without comments and scripts."""
    return F.regexp_replace(F.regexp_replace(html, COMMENT_PATTERN, ""), SCRIPT_PATTERN, "")


def decode_entities(text: Column) -> Column:
    """Decode numeric character references and the predefined names; the ampersand's name comes last."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(NUMERIC_REFERENCE), 0))

    def decoded(reference: Column) -> Column:
        digits = F.substring(reference, F.lit(3), F.length(reference) - 3)
        hexadecimal = F.lower(digits).startswith("x")
        number = F.when(hexadecimal, F.conv(F.substring(digits, F.lit(2), F.length(digits)), 16, 10)).otherwise(digits).cast("int")
        valid = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
        # Code points as UTF-32 text.
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(reference)

    text = F.aggregate(found, text, lambda t, r: F.replace(t, r, decoded(r)))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def extract_link_manifest(
    pages: DataFrame, html_col: str = "html", pattern: str = ARCHIVE_PATTERN, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Archive links as (href, name, kind), one row per link; the name is lower-cased.

    ``keep`` names page columns to carry along.
    """
    raw = F.regexp_extract_all(visible_html(F.col(html_col)), F.lit(HREF_PATTERN), 1)
    links = pages.select(*keep, F.explode(raw).alias("_raw"))
    unquoted = F.regexp_replace("_raw", r"""^["']|["']$""", "")
    return (
        links.select(*keep, F.regexp_replace(decode_entities(unquoted), r"^\s+|\s+$", "").alias("href"))
        .where(F.lower("href").endswith(ARCHIVE_SUFFIX) & F.col("href").rlike(pattern))
        .select(
            *keep,
            "href",
            F.lower(F.regexp_extract("href", pattern, 1)).alias("name"),
            F.regexp_extract("href", pattern, 2).alias("kind"),
        )
    )


def exclude_names(manifest: DataFrame, excluded: tuple[str, ...] | DataFrame = EXCLUDED_NAMES) -> DataFrame:
    """Drop links of the excluded communities, ignoring case.

    A short tuple becomes a filter; a table with a column ``name`` becomes an anti join.
    """
    if isinstance(excluded, DataFrame):
        names = excluded.select(F.lower("name").alias("_excluded"))
        return manifest.join(names, F.col("name") == F.col("_excluded"), "left_anti")
    return manifest.where(~F.col("name").isin(*(n.lower() for n in excluded)))
