"""Corpus profile: totals, distributions, text lengths, authors, and the printed report.

All functions take flat tables: ``submissions`` (one row each) and ``comments`` in the columns
of :func:`palaver.operators.threads.explode_comments`. From a thread store, pass
``thread_heads(threads)`` and ``explode_comments(threads, fields=...)``, naming the fields a
statistic needs, so that the scan reads no others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import utc_text
from palaver.operators.quantiles import one_row, quantiles_of_counts, value_counts
from palaver.operators.segments import fresh_key
from palaver.session import stage


def general_metadata(submissions: DataFrame) -> DataFrame:
    """Number of submissions, their time range, and how many are flagged over-18."""
    return submissions.agg(
        F.count(F.lit(1)).alias("n_submissions"),
        F.min("created_utc").alias("min_ts"),
        F.max("created_utc").alias("max_ts"),
        F.count_if("over_18").alias("n_nsfw"),
    ).select(
        "*",
        utc_text(F.col("min_ts")).alias("date_start"),
        utc_text(F.col("max_ts")).alias("date_end"),
        F.try_divide("n_nsfw", "n_submissions").alias("nsfw_share"),
    )


def thread_sizes(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """Number of comments per submission, zero included; comments on other threads do not matter.

    Bodies are not read, and comments are counted before they meet the submissions.
    """
    counts = (
        comments.groupBy(fresh_key("question_id").alias("_key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_key.question_id", "n")
    )
    return submissions.join(counts, F.col("id") == F.col("question_id"), "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("n_comments")
    )


def stored_thread_sizes(threads: DataFrame) -> DataFrame:
    """The same from stored threads, by list length; segments of a thread are added up.

    The length is taken of one narrow field, so that the scan leaves the bodies alone.
    """
    length = F.coalesce(F.array_size("top_level_comments.created_utc"), F.lit(0))
    return threads.groupBy("id").agg(F.sum(length).cast("bigint").alias("n_comments"))


def comment_count_distribution(sizes: DataFrame) -> DataFrame:
    """Mean, sample deviation, 1st / 50th / 99th percentile and maximum of thread sizes.

    Sizes are read once, into a table of distinct sizes and their counts; everything follows from that.
    """
    return _distribution(value_counts(sizes, "n_comments"))


def _distribution(counts: DataFrame) -> DataFrame:
    """The same from a table of distinct sizes (value, n)."""
    total, rows = F.sum(F.col("value").cast("double") * F.col("n")), F.sum("n")
    mean = counts.agg(F.try_divide(total, rows)).first()[0]
    apart = F.sum(F.pow(F.col("value") - F.lit(mean), F.lit(2)) * F.col("n"))
    moments = counts.agg(
        F.lit(mean).cast("double").alias("count_mean"),
        F.when(rows > 1, F.sqrt(apart / F.nullif(rows - 1, F.lit(0)))).alias("count_std"),
        F.max("value").alias("count_max"),
    )
    ranks = {"p01": (0.01, "nearest"), "p50": (0.5, "linear"), "p99": (0.99, "nearest")}
    return side_by_side(moments, one_row(counts, quantiles_of_counts(counts, ranks)))


def submission_content_stats(submissions: DataFrame) -> DataFrame:
    """Mean title length and mean and median score; submissions are read once, into a table of distinct scores."""
    length = F.char_length("title").cast("double")
    return _content(value_counts(submissions, "score", F.sum(length).alias("length"), F.count("title").alias("titles")))


def _content(counts: DataFrame) -> DataFrame:
    """The same from distinct scores (value, n, length, titles)."""
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    means = counts.agg(
        F.try_divide(F.sum("length"), F.sum("titles")).alias("title_len_mean"),
        F.try_divide(F.sum(F.col("value").cast("double") * F.col("n")), F.sum(known)).alias("score_mean"),
    )
    ranks = quantiles_of_counts(counts, {"score_median": (0.5, "linear")})
    return side_by_side(means, one_row(counts, ranks))


def comment_content_stats(comments: DataFrame) -> DataFrame:
    """Mean body length, upvotes and downvotes."""
    return comments.agg(
        F.avg(F.char_length("body")).alias("body_len_mean"),
        F.avg("ups").alias("ups_mean"),
        F.avg("downs").alias("downs_mean"),
    )


def side_by_side(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two one-row results as one row."""
    return first.withColumn("_one", F.lit(1)).join(second.withColumn("_one", F.lit(1)), "_one").drop("_one")


def author_flags(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """Each author once, with the sides they appear on; null authors are left out."""
    asked = submissions.select("author", F.lit(True).alias("asked"), F.lit(False).alias("answered"))
    answered = comments.select("author", F.lit(False).alias("asked"), F.lit(True).alias("answered"))
    return (
        asked.unionByName(answered)
        .where(F.col("author").isNotNull())
        .groupBy("author")
        .agg(F.bool_or("asked").alias("asked"), F.bool_or("answered").alias("answered"))
    )


def author_overlap(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """Distinct authors on either side, in all, and on both, counted in one pass."""
    return _overlap(author_flags(submissions, comments))


def _overlap(names: DataFrame) -> DataFrame:
    """The same from one row for each author (asked, answered)."""
    both = F.col("asked") & F.col("answered")
    return names.agg(
        F.count_if("asked").alias("n_submission_authors"),
        F.count_if("answered").alias("n_comment_authors"),
        F.count(F.lit(1)).alias("n_union"),
        F.count_if(both).alias("n_both"),
    ).select("*", F.coalesce(F.try_divide("n_both", "n_submission_authors"), F.lit(0.0)).alias("share_both"))


def author_union(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """Names on at least one side."""
    return author_flags(submissions, comments).select("author")


def author_intersection(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """Names on both sides."""
    return author_flags(submissions, comments).where(F.col("asked") & F.col("answered")).select("author")


# --- report ---------------------------------------------------------------------------------

# Section titles and line labels of the report.
GENERAL = "General Metadata"
COUNTS = "Comments per Submission (Top-Level)"
CONTENT = "Content Analysis (Lengths & Scores)"
AUTHORS = "Author Analysis"
LINE_FORMAT = "%-40s : %s"
RULE = "=" * 20


def _thousands(col: str) -> Column:
    return F.format_number(F.col(col), 0)


def _percent(col: str) -> Column:
    return _fixed_value(F.col(col) * 100, 2, "%")


def _fixed_value(value: Column, digits: int, unit: str) -> Column:
    pattern = "0." + "0" * digits if digits else "0"
    return F.concat(F.call_function("format_number", value.cast("double"), F.lit(pattern)), F.lit(unit))


def _fixed(col: str, digits: int, unit: str = "") -> Column:
    return _fixed_value(F.col(col), digits, unit)


def _lines(stats: DataFrame, start: int, section: str, rows: list[tuple[str, Column]]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(start + i).alias("line_no"),
            F.lit(section).alias("section"),
            F.lit(label).alias("label"),
            value.cast("string").alias("value"),
        )
        for i, (label, value) in enumerate(rows)
    ]
    return stats.select(F.inline(F.array(*entries)))


#: Kinds of rows in a profile's table of facts.
_THREAD, _SCORE, _AUTHOR, _WHOLE = range(4)
_TOTALS = ["flagged", "body_len", "bodies", "ups", "ups_n", "downs", "downs_n"]


def profile_facts(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """Everything that a report is derived from, in one stored table made by one pass over each input.

    A submission counts for its thread, its score, its author and the whole, a comment for its thread, its author and the
    whole; these counts are added up before they are shuffled, so a crowded thread or author is one row of each task.
    """
    nothing = {"text": None, "value": None, "n": 0, "present": False, "asked": False, "answered": False, "length": None, "titles": 0,
               "low": None, "high": None} | {c: 0 for c in _TOTALS}
    kinds = {"text": "string", "value": "bigint", "n": "bigint", "titles": "bigint", "length": "double", "low": "bigint", "high": "bigint"}
    kinds |= {c: "double" if c in ("body_len", "ups", "downs") else "bigint" for c in _TOTALS}

    def fact(kind: int, **given: Column | bool | int) -> Column:
        values = {k: v if isinstance(v, Column) else F.lit(v) for k, v in (nothing | given).items()}
        typed = [(values[k].cast(kinds[k]) if k in kinds else values[k]).alias(k) for k in nothing]
        return F.struct(F.lit(kind).alias("kind"), *typed)

    def measured(col: str, value: Column) -> dict[str, Column]:
        return {col: F.coalesce(value.cast("double"), F.lit(0.0)), f"{'bodies' if col == 'body_len' else col + '_n'}": value.isNotNull().cast("bigint")}

    by_submission = F.array(
        fact(_THREAD, text=F.col("id"), present=True),
        fact(_SCORE, value=F.col("score"), n=1, length=F.char_length("title"), titles=F.col("title").isNotNull()),
        fact(_AUTHOR, text=F.col("author"), asked=F.col("author").isNotNull()),
        fact(_WHOLE, n=1, low=F.col("created_utc"), high=F.col("created_utc"), flagged=F.coalesce("over_18", F.lit(False))),
    )
    of_body = {**measured("body_len", F.char_length("body")), **measured("ups", F.col("ups")), **measured("downs", F.col("downs"))}
    by_comment = F.array(
        fact(_THREAD, text=F.col("question_id"), n=1),
        fact(_AUTHOR, text=F.col("author"), answered=F.col("author").isNotNull()),
        fact(_WHOLE, **of_body),
    )
    rows = submissions.select(F.inline(by_submission)).unionByName(comments.select(F.inline(by_comment)))
    added = rows.groupBy("kind", "text", "value").agg(
        F.sum("n").alias("n"), F.bool_or("present").alias("present"), F.bool_or("asked").alias("asked"), F.bool_or("answered").alias("answered"),
        F.sum("length").alias("length"), F.sum("titles").alias("titles"), F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.sum(c).alias(c) for c in _TOTALS],
    )
    return stage(added, "facts")


def thread_report(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """The whole profile in long form: (line_no, section, label, value).

    Each input is read once, into :func:`profile_facts`; the sections are derived from that table.
    """
    facts = profile_facts(submissions, comments)
    kind = lambda k: facts.where(F.col("kind") == k)
    whole = kind(_WHOLE)
    general = whole.select(
        F.col("n").alias("n_submissions"), F.col("flagged").alias("n_nsfw"), utc_text(F.col("low")).alias("date_start"),
        utc_text(F.col("high")).alias("date_end"), F.try_divide("flagged", "n").alias("nsfw_share"),
    )
    sizes = kind(_THREAD).where("present").select(F.col("n").alias("n_comments"))
    scores = kind(_SCORE).select("value", "n", "length", "titles")
    content = whole.select(
        F.try_divide("body_len", "bodies").alias("body_len_mean"), F.try_divide("ups", "ups_n").alias("ups_mean"),
        F.try_divide("downs", "downs_n").alias("downs_mean"),
    )
    names = kind(_AUTHOR).where(F.col("text").isNotNull())
    parts = [
        _lines(
            general,
            0,
            GENERAL,
            [
                ("Total Submissions", _thousands("n_submissions")),
                ("Date Range Start", F.col("date_start")),
                ("Date Range End", F.col("date_end")),
                ("NSFW Submissions", F.concat(_thousands("n_nsfw"), F.lit(" ("), _percent("nsfw_share"), F.lit(")"))),
            ],
        ),
        _lines(
            comment_count_distribution(sizes),
            100,
            COUNTS,
            [
                ("Mean Comments per Sub", _fixed("count_mean", 4)),
                ("Std Dev Comments", _fixed("count_std", 4)),
                ("1st Percentile (p1)", _fixed("p01", 0)),
                ("Median (p50)", _fixed("p50", 0)),
                ("99th Percentile (p99)", _fixed("p99", 0)),
                ("Max Comments in one Sub", _fixed("count_max", 0)),
            ],
        ),
        _lines(
            _content(scores),
            200,
            CONTENT,
            [
                ("Avg Submission Title Length", _fixed("title_len_mean", 2, " chars")),
                ("Avg Submission Score", _fixed("score_mean", 2)),
                ("Median Submission Score", _fixed("score_median", 0)),
            ],
        ),
        _lines(
            content,
            210,
            CONTENT,
            [
                ("Avg Comment Body Length", _fixed("body_len_mean", 2, " chars")),
                ("Avg Comment Upvotes", _fixed("ups_mean", 2)),
                ("Avg Comment Downvotes", _fixed("downs_mean", 2)),
            ],
        ),
        _lines(
            _overlap(names),
            300,
            AUTHORS,
            [
                ("Unique Submission Authors", _thousands("n_submission_authors")),
                ("Unique Comment Authors", _thousands("n_comment_authors")),
                ("Total Unique Authors (Union)", _thousands("n_union")),
                ("Authors in Both (Intersection)", _thousands("n_both")),
                ("% Sub Authors who also Commented", _percent("share_both")),
            ],
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


#: The first line of each section, and the report's own first line.
_SECTION_LINES = {GENERAL: 0, COUNTS: 100, CONTENT: 200, AUTHORS: 300}
TITLE = "Statistics Report for"


def render_report(stats: DataFrame, source: str | None = None) -> DataFrame:
    """Report text, one row per line: a rule with the title ahead of each section, then its values.

    ``source`` names the input in a line ahead of all others.
    """
    body = stats.select(
        "line_no", F.lit(1).alias("part"), F.format_string(LINE_FORMAT, "label", "value").alias("line")
    )
    heads = [(no, -1, "") for no in _SECTION_LINES.values()]
    heads += [(no, 0, f"{RULE} {name} {RULE}") for name, no in _SECTION_LINES.items()]
    if source is not None:
        heads.append((-1, 0, f"{TITLE} {source}"))
    return stats.sparkSession.createDataFrame(heads, "line_no int, part int, line string").unionByName(body)
