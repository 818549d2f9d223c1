import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.functions.labels import SYSTEM_PROMPT, parse_label, render_prompt
from palaver.functions.standins import HashingEmbedder, keyword_generator
from palaver.functions.vectors import cosine, dot, l2_normalize, mean_vectors, nan_to_zero
from palaver.operators import inference

NAN, INF = float("nan"), float("inf")


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<float>")


def test_nan_to_zero_leaves_infinity(spark):
    row = _vectors(spark, [[1.0, NAN, INF, -INF]]).select(nan_to_zero(F.col("v"))).first()[0]
    assert row == [1.0, 0.0, INF, -INF]


def test_l2_normalize(spark):
    rows = [r[0] for r in _vectors(spark, [[3.0, 4.0], [0.0, 0.0], [1e-9, 0.0]]).select(l2_normalize(F.col("v"))).collect()]
    assert np.allclose(rows[0], [0.6, 0.8]) and rows[1] == [0.0, 0.0]
    assert math.isclose(rows[2][0], float(np.float32(1e-9)) / 1e-8)


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "a array<double>, b array<double>")
    assert df.select(dot(F.col("a"), F.col("b"))).first()[0] == 1.0
    got = df.select(cosine(F.col("a"), F.col("b"))).first()[0]
    assert math.isclose(got, 1 / math.sqrt(50))


def test_mean_vectors(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(200, 5)).astype(np.float32)
    names = [f"a{i % 7}" if i % 3 else "hot" for i in range(200)]
    df = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, values)], "author string, embedding array<float>").repartition(6)
    got = {r["author"]: r for r in mean_vectors(df, "author", "embedding").collect()}
    for name in set(names):
        mine = values[[n == name for n in names]]
        assert got[name]["num_comments_used"] == len(mine)
        assert np.allclose(got[name]["embedding"], mine.astype(np.float64).mean(axis=0), atol=1e-6)
    schema = mean_vectors(df, "author", "embedding").schema
    assert schema["embedding"].dataType.simpleString() == "array<float>"


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_embed_texts(spark, batch):
    texts = [f"one two{i % 4} three" for i in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string").repartition(4)
    expected = HashingEmbedder(8)(texts)
    plain = {r["i"]: r["embedding"] for r in inference.embed_texts(df, "body", lambda: HashingEmbedder(8), ["i"], batch_size=batch).collect()}
    unit = {r["i"]: r["embedding"] for r in inference.embed_texts(df, "body", lambda: HashingEmbedder(8), ["i"], True, batch).collect()}
    for i, v in enumerate(expected):
        assert np.allclose(plain[i], v)
        assert np.allclose(unit[i], v / max(np.linalg.norm(v), 1e-12), atol=1e-6)


def test_embed_texts_of_nothing(spark):
    df = spark.createDataFrame([], "i int, body string")
    assert inference.embed_texts(df, "body", lambda: HashingEmbedder(8), ["i"]).collect() == []


def test_embed_authors_averages(spark):
    rows = [("ann", 0, "a b"), ("ann", 1, "a"), ("bob", 0, "c")]
    df = spark.createDataFrame(rows, "author string, segment int, body string")
    model = HashingEmbedder(8)
    got = {r["author"]: (r["embedding"], r["num_comments_used"]) for r in inference.embed_authors(df, lambda: HashingEmbedder(8)).collect()}
    assert np.allclose(got["ann"][0], model(["a b", "a"]).mean(axis=0)) and got["ann"][1] == 2


def test_parse_label(spark):
    cases = {
        "Valid": "Valid", " valid. ": "Valid", "It is INVALID!": "Invalid", "Valid or invalid": "Invalid",
        "not valid": "Valid", "in-valid": "Invalid", "unsure": None, "": None, None: None, "v a l i d": None,
        "Inválid": None, "**Valid**": "Valid", "Ünvalid": "Valid",
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r[0] for r in df.select(parse_label(F.col("c"))).collect()] == list(cases.values())


def test_render_prompt(spark):
    chat = spark.createDataFrame([('Why "so"?',)], "t string").select(render_prompt(F.col("t"))).first()[0]
    assert [m["role"] for m in chat] == ["system", "user"]
    assert chat[0]["content"] == SYSTEM_PROMPT and chat[1]["content"] == 'Question: "Why "so"?"'


def test_classify_texts_drops_unreadable_replies(spark):
    rows = [("1", "the x"), ("2", "und x"), ("3", "zzz"), ("4", "eau")]
    df = spark.createDataFrame(rows, "id string, title string").repartition(2)
    got = {r["id"]: r["label"] for r in inference.classify_texts(df, keyword_generator, batch_size=1).collect()}
    assert got == {"1": "Valid", "2": "Invalid", "4": "Invalid"}
    plan = inference.classify_texts(df, keyword_generator)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
