"""JSON lines: a typed scan, and a projection that keeps absent keys absent."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD = "_bad_line"


def read_jsonl(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    on_error: str = "drop",
    observation: Observation | None = None,
) -> DataFrame:
    """Scan JSON lines with a fixed schema; missing keys are NULL and blank lines are skipped.

    A field declared as string takes whatever scalar the file holds; of a repeated key the last value counts. Lines that are
    not JSON objects are dropped (``drop``), kept in a ``_bad_line`` column (``keep``), or end the
    job (``fail``). An ``observation`` receives ``n_lines`` and ``n_bad`` once the rows have
    been read, without a pass of its own.

    Files are read as lines and each line is parsed once, as a list of one element that is unnested, so that whatever is
    asked of the rows, a count or a constant too, sees the same ones.
    """
    if on_error not in ("drop", "keep", "fail"):
        raise ValueError(f"on_error must be drop, keep or fail, not {on_error!r}")
    with_bad = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    lines = read_lines(spark, path).where(F.trim("value") != "")
    rows = lines.select(F.inline(F.array(F.from_json("value", with_bad, options))))
    if on_error == "fail":
        message = F.concat(F.lit("not a JSON object: "), F.substring(_BAD, 1, 200))
        checked = rows.withColumn(_BAD, F.when(F.col(_BAD).isNotNull(), F.raise_error(message)))
        rows, on_error = checked, "drop"
    if observation is not None:
        bad = F.count_if(F.col(_BAD).isNotNull())
        rows = rows.observe(observation, F.count(F.lit(1)).alias("n_lines"), bad.alias("n_bad"))
    return rows if on_error == "keep" else rows.where(F.col(_BAD).isNull()).drop(_BAD)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Unparsed lines in a column ``value``."""
    return spark.read.text(path)


def _members(line: Column) -> Column:
    """The members of a JSON object as a map; NULL if the line is none.

    The strict parser refuses an object that repeats a key. Such lines are parsed again as a list of members, of which the
    last of each key stays, in order of the keys; a repeated key inside a member's own value is still refused.
    """
    strict = F.try_variant_get(F.try_parse_json(line), "$", "map<string,variant>")
    every = F.map_entries(F.from_json(line, "map<string,variant>", {"allowNonNumericNumbers": "false"}))

    def is_last(entry: Column, at: Column) -> Column:
        return ~F.exists(F.slice(every, at + 2, F.size(every)), lambda later: later["key"] == entry["key"])

    last = F.map_from_entries(F.filter(every, is_last))
    keys = F.array_sort(F.map_keys(last))
    return F.coalesce(strict, F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(last, k))))


def projected_json(line: Column, keys: list[str] | tuple[str, ...]) -> Column:
    """The listed keys of a JSON object as JSON text; NULL if the line is not an object.

    A key that the object lacks stays out; a key whose value is null stays in; of a repeated key the last value counts.
    """
    return F.to_json(F.map_filter(_members(line), lambda k, _: k.isin(*keys)), {"ignoreNullFields": "false"})


def project_json_keys(df: DataFrame, keys: list[str] | tuple[str, ...], col: str = "value") -> DataFrame:
    """Replace each line by its projection and drop lines that are not JSON objects.

    Exploding a list of at most one element parses each line once; a filter on the result
    would be pushed below the projection and parse it again.
    """
    found = F.explode(F.array_compact(F.array(projected_json(F.col(col), keys))))
    return df.select(*(found.alias(col) if c == col else F.col(c) for c in df.columns))


def count_bad_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Lines read, and lines that are not JSON objects."""
    parsed = _members(F.col(col))
    return df.where(F.trim(F.col(col)) != "").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(parsed.isNull()).alias("n_bad")
    )


def write_jsonl(df: DataFrame, path: str, col: str = "value", mode: str = "errorifexists") -> None:
    """Write one JSON text column as lines."""
    df.select(F.col(col).alias("value")).write.mode(mode).text(path)


def suffixed_path(path: str, suffix: str = "_filtered") -> str:
    """``dir/name.ext`` to ``dir/name<suffix>.ext``."""
    base, ext = os.path.splitext(path)
    return f"{base}{suffix}{ext}"
