"""Parquet tables with declared schemas, and the text report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STR, _LONG = T.StringType(), T.LongType()

COMMENT_STRUCT = T.StructType(
    [
        T.StructField("id", _STR),
        T.StructField("body", _STR),
        T.StructField("ups", _LONG),
        T.StructField("downs", _LONG),
        T.StructField("created_utc", _LONG),
        T.StructField("author", _STR),
    ]
)
THREAD_SCHEMA = T.StructType(
    [
        T.StructField("id", _STR),
        T.StructField("title", _STR),
        T.StructField("author", _STR),
        T.StructField("created_utc", _LONG),
        T.StructField("over_18", T.BooleanType()),
        T.StructField("score", _LONG),
        T.StructField("num_comments", _LONG),
        T.StructField("segment", T.IntegerType()),
        T.StructField("top_level_comments", T.ArrayType(COMMENT_STRUCT)),
    ]
)
CLASSIFIED_SCHEMA = T.StructType([T.StructField(c, _STR) for c in ("id", "title", "label")])
STYLE_SCHEMA = T.StructType(
    [
        T.StructField("author", _STR),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("num_comments_used", T.IntegerType()),
    ]
)
ANSWER_SCHEMA = T.StructType(
    [
        T.StructField("question_id", _STR),
        T.StructField("author", _STR),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Parquet scan that reads only ``columns``, if given."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def write_table(df: DataFrame, path: str, schema: T.StructType, mode: str = "errorifexists") -> None:
    """Write Parquet (zstd) under a declared schema."""
    conform(df, schema).write.mode(mode).option("compression", "zstd").parquet(path)


def write_report(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write rendered report lines in order to one text file; a report has a few dozen lines."""
    ordered = lines.coalesce(1).sortWithinPartitions("line_no", "part")
    ordered.select(F.col("line").alias("value")).write.mode(mode).text(path)
