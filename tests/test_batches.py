"""Batches of like length for models."""

import random

import numpy as np
from pyspark.sql import functions as F

from palaver.functions.standins import HashingEmbedder
from palaver.operators import inference


def padded(lengths, batches):
    return sum(len(b) * max(min(lengths[i], inference.COUNTED_CHARS) for i in b) for b in batches)


def test_batches_hold_every_text_once_within_the_budget():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.choice([0, rng.randrange(60), rng.randrange(9000)]) for _ in range(rng.randrange(0, 300))]
        size, budget = rng.randrange(1, 40), rng.choice([1, 5000, 32768])
        batches = list(inference.length_batches(lengths, size, budget))
        assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
        assert all(len(b) <= size and (len(b) == 1 or padded(lengths, [b]) <= budget) for b in batches)


def test_padding_shrinks():
    rng = random.Random(3)
    lengths = [int(rng.lognormvariate(5.5, 1)) for _ in range(2048)]
    plain = [list(range(k, min(k + 32, 2048))) for k in range(0, 2048, 32)]
    useful = sum(min(n, inference.COUNTED_CHARS) for n in lengths)
    assert padded(lengths, inference.length_batches(lengths, 32)) < 1.15 * useful < 0.4 * padded(lengths, plain)


def padded_model():
    """A stand-in that refuses batches of unlike length or above the budget."""
    model, counted, full = HashingEmbedder(16), inference.COUNTED_CHARS, inference.FULL_TEXTS

    def embed(texts):
        sizes = [min(len(t or ""), counted) for t in texts]
        if sizes != sorted(sizes) or len(texts) * sizes[-1] > max(sizes[-1], full * counted):
            raise ValueError(f"a batch of {sizes}")
        return model([t or "" for t in texts])

    return embed


def test_vectors_equal_those_of_plain_batches(spark):
    model = padded_model()
    load = lambda: model
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([0, 1, 9, 300, 900])))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, body string")
    got = {r["id"]: r["embedding"] for r in inference.embed_texts(df, "body", load, ["id"]).collect()}
    wanted = HashingEmbedder(16)([t for _, t in rows])
    assert np.allclose([got[i] for i, _ in rows], wanted, atol=1e-6)
    authors = df.select(F.lit("a").alias("author"), F.lit(0).alias("segment"), "body")
    mean = inference.embed_authors(authors, load).first()
    assert mean["num_comments_used"] == 200 and np.allclose(mean["embedding"], wanted.mean(axis=0), atol=1e-6)
