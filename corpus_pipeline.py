"""Documents to packed sequences: language, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.llm import language, packing, paragraphs, queries, simhash
from palaver.session import ship_package, stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted."""
    ship_package(spark)
    return language.keep_identified(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: fingerprints of three-word shingles that differ in two bits or fewer."""
    ship_package(spark)
    return simhash.keep_first(docs)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that a document of a smaller id has."""
    ship_package(spark)
    return paragraphs.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1,024 tokens."""
    ship_package(spark)
    return packing.pack(docs, queries.byte_vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identified),
    ("simhash_near_dedup", distinct_documents),
    ("substring_dedup", distinct_passages),
    ("packing", packed),
]

#: SQL expresses neither hashing of shingles nor the tokenizer; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and read again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        rows = stage(step(spark, rows, sf_dir), name)
    return rows
