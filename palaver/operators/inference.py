"""Distributed model inference: the user supplies the model, Spark supplies the rows.

A model is given as a factory, a function without arguments that loads it and returns a
callable on a list of texts. The factory runs once per Python worker, never on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions.labels import VALID, parse_label, render_prompt
from palaver.functions.vectors import ANSWER_EPS
from palaver.operators.segments import fresh_key
from palaver.session import stage

Embedder = Callable[[list[str]], np.ndarray]
Generator = Callable[[list[list[dict]]], list[str]]

# Texts handed to a model at once.
STYLE_BATCH = 32
ANSWER_BATCH = 8

#: Rows that one task gives to a model, and segments of authors.
ROWS_PER_TASK = 1024
SEGMENTS_PER_TASK = 4
#: Characters up to which a text counts, as models cut longer ones (four to a token), and texts of that length whose padded size closes a batch.
COUNTED_CHARS = 2048
FULL_TEXTS = 16

#: Models of this worker by what their factory pickles to.
_MODELS: dict[str, Callable] = {}


def _loader(factory: Callable[[], Callable]) -> Callable[[], Callable]:
    """Loads the factory's model when first called in a worker, and returns it again in later tasks."""
    key = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def model() -> Callable:
        if key not in _MODELS:
            _MODELS[key] = factory()
        return _MODELS[key]

    return model


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows, stored, in tasks of about equal numbers: model cost follows rows, not bytes.

    An explicit number of partitions is not coalesced by adaptive execution.
    """
    stored = stage(df, "model-input")
    return stored.repartition(max(1, -(-stored.count() // rows_per_task)))


def length_batches(lengths: list[int], batch_size: int, budget: int = FULL_TEXTS * COUNTED_CHARS) -> Iterator[list[int]]:
    """Places of texts in batches of like length, shortest first.

    A model pads a batch to its longest text, so a batch is closed before its padded size passes ``budget`` characters, or when it
    has ``batch_size`` texts. A text longer than ``COUNTED_CHARS`` counts as that long.
    """
    batch: list[int] = []
    for at in sorted(range(len(lengths)), key=lengths.__getitem__):
        longest = min(lengths[at], COUNTED_CHARS)
        if batch and (len(batch) == batch_size or longest * (len(batch) + 1) > budget):
            yield batch
            batch = []
        batch.append(at)
    if batch:
        yield batch


def _embedded(embedder: Embedder, texts: list[str | None], batch_size: int) -> np.ndarray:
    """A vector for each text, in the order of the texts; models see them in batches of like length."""
    out = None
    for batch in length_batches([len(t or "") for t in texts], batch_size):
        vectors = np.asarray(embedder([texts[i] for i in batch]), dtype=np.float64)
        if out is None:
            out = np.empty((len(texts), vectors.shape[1]))
        out[batch] = vectors
    return out


def embed_texts(
    df: DataFrame,
    text_col: str,
    factory: Callable[[], Embedder],
    keep: list[str],
    normalize: bool = False,
    batch_size: int = STYLE_BATCH,
    out: str = "embedding",
    profile: ResourceProfile | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Replace ``text_col`` by a float vector; ``keep`` names the columns carried along.

    Rows cross to Python once, in Arrow batches, and are embedded in batches of like length, ``batch_size`` at most.
    ``profile`` asks for resources, such as one GPU per task, for this stage alone.
    """
    source = spread(df.select(*keep, text_col), rows_per_task)
    model = _loader(factory)
    fields = [source.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.FloatType(), True), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = model()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = _embedded(embedder, batch.column(text_col).to_pylist(), batch_size)
            if normalize:
                lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                vectors = vectors / np.maximum(lengths, ANSWER_EPS)
            width = vectors.shape[1]
            offsets = np.arange(0, (batch.num_rows + 1) * width, width, dtype=np.int32)
            column = pa.ListArray.from_arrays(offsets, pa.array(vectors.astype(np.float32).ravel()))
            arrays = [batch.column(c) for c in keep] + [column]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, out])

    return source.mapInArrow(run, schema, profile=profile)


def embed_authors(
    comments: DataFrame,
    factory: Callable[[], Embedder],
    batch_size: int = STYLE_BATCH,
    profile: ResourceProfile | None = None,
    segments_per_task: int | None = None,
) -> DataFrame:
    """Style vector per author: the mean over the embedded bodies.

    Takes the rows of :func:`palaver.operators.authors.prolific_comments`. Bodies are grouped
    by (author, segment) and only the sum of each group leaves Python, so what is shuffled is
    the text, once, and never a vector per comment. With a ``profile`` the sums are made by a
    stage that can ask for resources: rows of a segment lie together in a task, one after another.
    """
    schema = "author string, sums array<double>, n bigint"
    model = _loader(factory)

    def row(author: str, texts: list[str]) -> pa.RecordBatch:
        total = _embedded(model(), texts, batch_size).sum(axis=0)
        return pa.RecordBatch.from_pydict(
            {
                "author": pa.array([author], pa.string()),
                "sums": pa.array([total], pa.list_(pa.float64())),
                "n": pa.array([len(texts)], pa.int64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("author", "segment", "body")]
            for author, segment, body in zip(*columns):
                if texts and (author, segment) != held:
                    yield row(held[0], texts)
                    texts = []
                held = (author, segment)
                texts.append(body)
        if texts:
            yield row(held[0], texts)

    source = comments.select("author", "segment", "body")
    keys = ["author", "segment"]
    if segments_per_task:
        stored = stage(source, "model-input")
        tasks = -(-stored.select(*keys).distinct().count() // segments_per_task)
        source = stored.repartition(max(1, tasks), *keys)
    else:
        source = source.repartition(*keys)
    parts = source.sortWithinPartitions(*keys).mapInArrow(run, schema, profile=profile)
    return (
        parts.groupBy(fresh_key("author").alias("_key"))
        .agg(Summarizer.sum(array_to_vector("sums")).alias("_sum"), F.sum("n").cast("int").alias("num_comments_used"))
        .select(
            "_key.author",
            F.transform(vector_to_array("_sum"), lambda s: (s / F.col("num_comments_used")).cast("float")).alias("embedding"),
            "num_comments_used",
        )
    )


def embed_answers(
    answers: DataFrame,
    factory: Callable[[], Embedder],
    batch_size: int = ANSWER_BATCH,
    profile: ResourceProfile | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Unit vector per answer: (question_id, author, embedding)."""
    keep = ["question_id", "author"]
    return embed_texts(
        answers, "body", factory, keep, normalize=True, batch_size=batch_size, profile=profile, rows_per_task=rows_per_task
    )


def classify_texts(
    df: DataFrame,
    factory: Callable[[], Generator],
    id_col: str = "id",
    text_col: str = "title",
    batch_size: int = 32,
    profile: ResourceProfile | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Label texts with a chat model; rows whose reply names neither label are dropped."""
    model = _loader(factory)
    prompts = spread(df.select(id_col, text_col), rows_per_task).select(id_col, text_col, render_prompt(F.col(text_col)).alias("_chat"))
    schema = T.StructType([prompts.schema[id_col], prompts.schema[text_col], T.StructField("_reply", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = model()
        for batch in batches:
            chats = batch.column("_chat").to_pylist()
            replies: list[str | None] = [None] * len(chats)
            lengths = [sum(len(m["content"] or "") for m in chat) for chat in chats]
            for some in length_batches(lengths, batch_size):
                for at, reply in zip(some, generate([chats[i] for i in some])):
                    replies[at] = reply
            arrays = [batch.column(id_col), batch.column(text_col), pa.array(replies, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, text_col, "_reply"])

    return (
        prompts.mapInArrow(run, schema, profile=profile)
        .select(id_col, text_col, parse_label(F.col("_reply")).alias("label"))
        .where(F.col("label").isNotNull())
    )


def label_distribution(classified: DataFrame) -> DataFrame:
    """Rows per label in label order, with the overall share of Valid and of all the rest."""
    per_label = classified.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    valid = F.coalesce(F.sum(F.when(F.col("label") == VALID, F.col("n"))), F.lit(0))
    totals = per_label.groupBy("_one").agg(F.sum("n").alias("total"), F.try_divide(valid, F.sum("n")).alias("valid_share"))
    totals = totals.withColumn("invalid_share", F.lit(1.0) - F.col("valid_share"))
    return (
        per_label.join(F.broadcast(totals), "_one")
        .select("label", "n", F.try_divide("n", "total").alias("share"), "total", "valid_share", "invalid_share")
        .orderBy("label")
    )
