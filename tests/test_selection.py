import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palaver.operators import answers, authors, inference, sampling

FLAT = "question_id string, comment_id string, body string, ups bigint, downs bigint, created_utc bigint, author string"


def _flat(spark, rows):
    return spark.createDataFrame([(q, i, b, 0, 0, t, a) for q, i, b, t, a in rows], FLAT)


def _random_comments(seed=5, n=600):
    rng = random.Random(seed)
    names = ["hot"] * 6 + [f"a{i}" for i in range(12)] + [None]
    return [
        (f"q{rng.randrange(9)}", f"c{i:04d}", "x" * rng.choice([3, 9, 10, 30]), rng.choice([None, 1, 2, 3]), rng.choice(names))
        for i in range(n)
    ]


def test_prolific_counts_after_the_length_filter(spark):
    rows = _random_comments()
    df = _flat(spark, rows)
    long = [r for r in rows if len(r[2]) >= 10 and r[4] is not None]
    counts = {}
    for r in long:
        counts[r[4]] = counts.get(r[4], 0) + 1
    kept = {a for a, n in counts.items() if n >= 20}
    assert kept and kept != set(counts)
    got = {r["author"]: r["n_comments"] for r in authors.prolific_authors(df, 20, 10).collect()}
    assert got == {a: counts[a] for a in kept}
    ids = {r["comment_id"] for r in authors.prolific_comments(df, 20, 10).collect()}
    assert ids == {r[1] for r in long if r[4] in kept}


@pytest.mark.parametrize("per_row", [7, 10_000])
def test_author_bodies_are_bounded_and_whole(spark, per_row):
    rows = _random_comments()
    lists = authors.author_bodies(_flat(spark, rows), 20, 10, per_row).collect()
    kept = {r["author"] for r in lists}
    for name in kept:
        mine = [x for r in sorted(lists, key=lambda r: r["segment"]) if r["author"] == name for x in r["bodies"]]
        assert mine == [r[2] for r in sorted(rows, key=lambda r: r[1]) if r[4] == name and len(r[2]) >= 10]
    assert max(len(r["bodies"]) for r in lists) <= per_row
    segments = [r for r in lists if r["author"] == "hot"]
    assert len(segments) > 5 if per_row == 7 else len(segments) == 1


def test_answer_candidates_and_oldest(spark):
    rows = _random_comments(8)
    df = _flat(spark, rows)
    labels = spark.createDataFrame(
        [("q1", "t", "Valid"), ("q2", "t", "Invalid"), ("q3", "t", "Valid"), ("q3", "t", "Valid")], "id string, title string, label string"
    )
    questions = answers.valid_questions(labels)
    assert sorted(r["id"] for r in questions.collect()) == ["q1", "q3"]
    styled = spark.createDataFrame([("hot",), ("a1",), ("a1",)], "author string")
    found = answers.answer_candidates(df, questions, styled, 10)
    expected = [r for r in rows if r[0] in ("q1", "q3") and r[4] in ("hot", "a1") and len(r[2]) >= 10]
    assert sorted(r["comment_id"] for r in found.collect()) == sorted(r[1] for r in expected)
    first = {}
    for r in sorted(expected, key=lambda r: (r[3] is not None, r[3] or 0, r[1])):
        first.setdefault((r[0], r[4]), r[1])
    got = {(r["question_id"], r["author"]): r["comment_id"] for r in answers.oldest_answer(found).collect()}
    assert got == first


def test_oldest_answer_is_thinned_before_its_shuffle(spark):
    df = _flat(spark, _random_comments())
    joined = answers.answer_candidates(
        df, df.select(F.col("question_id").alias("id")), df.select("author"), 1
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = answers.oldest_answer(joined)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final, partial = plan.index("row_number(), 1, Final"), plan.index("row_number(), 1, Partial")
    assert "Exchange hashpartitioning" in plan[final:partial]


def _hash(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 10, 499, 500, 900])
def test_sample_is_exact_and_repeatable(spark, n):
    ids = [f"s{i}" for i in range(500)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id string, title string")
    expected = sorted(ids, key=_hash)[:n]
    assert [r["id"] for r in sampling.sample_rows(df.repartition(3), "id", n).collect()] == expected
    assert [r["id"] for r in sampling.sample_rows(df.repartition(9), "id", n).collect()] == expected


def test_sample_skips_missing_titles(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "id string, title string")
    assert [tuple(r) for r in sampling.sample_titles(df, 5).collect()] == [("b", "x")]


def test_label_examples(spark):
    rows = [(f"i{k}", "t", "Valid" if k % 5 else "Invalid") for k in range(100)]
    df = spark.createDataFrame(rows, "id string, title string, label string")
    got = sampling.label_examples(df, 7)
    for label in ("Valid", "Invalid"):
        expected = sorted((i for i, _, x in rows if x == label), key=_hash)[:7]
        assert sorted(r["id"] for r in got.where(F.col("label") == label).collect()) == sorted(expected)
    assert "Partial" in got._jdf.queryExecution().executedPlan().toString()


def test_label_distribution(spark):
    df = spark.createDataFrame([("1", "Valid"), ("2", "Invalid"), ("3", "Valid"), ("4", "Valid")], "id string, label string")
    rows = [tuple(r) for r in inference.label_distribution(df).collect()]
    assert rows == [("Invalid", 1, 0.25, 4, 0.75, 0.25), ("Valid", 3, 0.75, 4, 0.75, 0.25)]
    assert inference.label_distribution(df.limit(0)).collect() == []


def test_sample_keeps_rows_without_an_id(spark):
    from palaver.operators.sampling import sample_rows

    df = spark.createDataFrame([("a", 1), (None, 2)], "id string, v int")
    assert sorted(r.v for r in sample_rows(df, n=5).collect()) == [1, 2]
