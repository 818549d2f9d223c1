"""SimHash near-duplicates by meeting in the middle.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius share one, so
shuffling on variants finds every link; a variant's group cannot exceed the number of variants of one fingerprint, so
no group is crowded. Colliding pairs are deduplicated and verified. Equal fingerprints are collapsed before that.

Null texts are empty texts; texts without words have fingerprint zero and link like any other. A row with a null id has
a fingerprint and a class; ids of a class are compared without nulls, and a class of null ids only has a null
component. Repeated rows stay repeated. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import slices, text_buffer, text_column, word_spans
from palaver.llm.components import components
from palaver.session import stage

#: Words of a shingle, and bits that linked fingerprints may differ in.
SHINGLE, RADIUS = 3, 2


def fingerprint(data: bytes, starts: np.ndarray, ends: np.ndarray, shingle: int, seed: int = 42) -> int:
    """A bit is 1 if it is set in more than half of the shingles' hashes, repeats included."""
    if not len(starts):
        return 0
    h = xxhash.xxh64_intdigest
    lengths = ends - starts
    last = np.cumsum(lengths + 1) - 1
    joined = b" ".join([data[i:j] for i, j in zip(starts.tolist(), ends.tolist())])
    width = min(shingle, len(starts))
    begins, stops = (last - lengths)[: len(last) - width + 1].tolist(), last[width - 1 :].tolist()
    hashes = np.fromiter([h(joined[i:j], seed) for i, j in zip(begins, stops)], np.uint64, len(begins))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, key: str, text: str, shingle: int, *more: str) -> DataFrame:
    """(id, fingerprint as a signed long) of every row, and ``more`` columns of type long."""

    def run(batches):
        for batch in slices(batches, "text"):
            data, at = text_buffer(batch.column("text"))
            starts, ends, first = word_spans(data, at)
            found = []
            for d in range(batch.num_rows):
                some = slice(first[d], first[d + 1])
                row = data[at[d] : at[d + 1]].tobytes().lower()
                found.append(fingerprint(row, starts[some] - at[d], ends[some] - at[d], shingle))
            kept = ["id", *more]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(found, pa.int64())], [*kept, "fingerprint"])

    rows = df.select(F.col(key).cast("long").alias("id"), *more, text_column(df, text).alias("text"))
    return rows.mapInArrow(run, "id long, " + "".join(f"{c} long, " for c in more) + "fingerprint long")


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all within ``radius`` bits, directly or through others.

    Of an even radius, all fingerprints that share a variant are within it of each other, so each is linked to the
    group's least; of an odd one (whose variants reach half of the next even number) all pairs are verified.
    """
    half = (radius + 1) // 2
    masks = [0] + [sum(1 << b for b in bits) for n in range(1, half + 1) for bits in combinations(range(64), n)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    one = prints.select("fingerprint").distinct()
    variants = one.select("fingerprint", F.explode(signed).alias("mask")).select(
        F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"), "fingerprint"
    )
    if radius % 2:
        other = variants.withColumnRenamed("fingerprint", "b")
        pairs = variants.withColumnRenamed("fingerprint", "a").join(other, "variant").select("a", "b")
    else:
        least = F.min("fingerprint").over(Window.partitionBy("variant"))
        pairs = variants.select(least.alias("a"), F.col("fingerprint").alias("b"))
    pairs = pairs.where(F.col("a") < F.col("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, component, component_id) of the distinct fingerprints of stored rows (id, fingerprint)."""
    linked = components(stage(ball_links(prints, radius), "balls"), "simhash")
    least = prints.groupBy("fingerprint").agg(F.min("id").alias("least"))
    classes = least.join(linked.withColumnRenamed("v", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component"), "least"
    )
    classes = stage(classes, "classes")
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return stage(classes.join(smallest, "component").select("fingerprint", "component", "component_id"), "classes")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id is the smallest id reachable by links."""
    prints = stage(fingerprints(df, key, text, shingle), "prints")
    return prints.join(_classes(prints, radius), "fingerprint").select("id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each class, with its own columns: a row of the smallest id.

    A row is known by its id and its text: rows of one id whose texts are no near copies all stay. Where several rows of a
    class have its smallest id, the text of the least hash stays, and of rows equal in id and text one. Rows with a null id
    can't be named as anyone's copy; they stay as they are.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.where(F.col(key).isNotNull()).select(
        columns, F.col(key).cast("long").alias("id"), F.xxhash64(text_column(docs, text)).alias("mark"), text_column(docs, text).alias("text")
    )
    prints = stage(fingerprints(rows.select("id", "text", "mark"), "id", "text", shingle, "mark"), "prints")
    first = prints.join(_classes(prints, radius), "fingerprint").groupBy("component").agg(F.min(F.struct("id", "mark")).alias("first"))
    first = stage(first.select("first.id", "first.mark"), "first")
    kept = rows.select("whole", "id", "mark").join(first, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    return kept.select("whole.*").union(docs.where(F.col(key).isNull()))
