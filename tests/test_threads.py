import random

import pytest

from palaver.operators import clean, threads

SUB = "id string, title string, author string, created_utc string, over_18 string, score string, num_comments string"
COM = "id string, body string, ups string, downs string, created_utc string, author string, parent_id string, link_id string"


def _sub(i, author="ann", **kw):
    row = dict(id=i, title="T", author=author, created_utc="10.0", over_18="true", score="3", num_comments="1")
    row.update(kw)
    return tuple(row[c] for c in clean.SUBMISSION_COLUMNS)


def _com(i, link, author="bob", body="text", parent=None, created="5", **kw):
    row = dict(id=i, body=body, ups="1", downs="0", created_utc=created, author=author, parent_id=parent or f"t3_{link}", link_id=f"t3_{link}")
    row.update(kw)
    return tuple(row[c] for c in clean.COMMENT_COLUMNS)


def test_clean_submissions(spark):
    raw = spark.createDataFrame(
        [
            _sub("a"), _sub("b", "[deleted]"), _sub("c", None), _sub("d", "AutoModerator"), _sub("e", "automoderator"),
            _sub("f", "sneakpeekbot"), _sub("g", created_utc="n/a", over_18=None, score="-1.9"),
        ],
        SUB,
    )
    got = {r["id"]: r for r in clean.clean_submissions(raw).collect()}
    assert set(got) == {"a", "e", "g"}
    assert got["g"]["created_utc"] is None and got["g"]["over_18"] is False and got["g"]["score"] == -1
    assert got["a"]["over_18"] is True and got["a"]["created_utc"] == 10


def test_clean_comments(spark):
    raw = spark.createDataFrame(
        [
            _com("1", "a"), _com("2", "a", body="[deleted]"), _com("3", "a", body="[removed]"), _com("4", "a", body=None),
            _com("5", "a", parent="t1_1"), _com("6", "a", author="haiku_bot"), _com("7", "a", author=None),
            _com("8", "a", body="[Deleted]"), _com("9", "a", parent_id=None),
        ],
        COM,
    )
    got = clean.clean_comments(raw).collect()
    assert {r["id"] for r in got} == {"1", "8"}
    assert {r["link_id_clean"] for r in got} == {"a"}


def test_matched_comments_need_the_full_name(spark):
    subs = clean.clean_submissions(spark.createDataFrame([_sub("a"), _sub("a")], SUB))
    coms = clean.clean_comments(
        spark.createDataFrame([_com("1", "a"), _com("2", "zzz"), _com("3", "a", link_id="a", parent_id="t3_a")], COM)
    )
    assert [r["id"] for r in clean.matched_comments(coms, subs).collect()] == ["1"]


def _random_dump(spark, seed=3):
    rng = random.Random(seed)
    subs = [_sub(f"s{i}") for i in range(30)]
    links = ["s7"] * 120 + [f"s{rng.randrange(40)}" for _ in range(240)]
    coms = [_com(f"c{i}", link, created=rng.choice(["1", "2", "3", None])) for i, link in enumerate(links)]
    expected = {s[0]: [] for s in subs}
    for c in coms:
        key = c[7][3:]
        if key in expected:
            expected[key].append(((-1 if c[4] is None else int(c[4])), c[0]))
    s = clean.clean_submissions(spark.createDataFrame(subs, SUB))
    c = clean.clean_comments(spark.createDataFrame(coms, COM))
    return s, c, {k: sorted(v) for k, v in expected.items()}


@pytest.mark.parametrize("partitions", ["1", "7"])
@pytest.mark.parametrize("per_row", [5, 50, 10_000])
def test_assemble_threads_against_brute_force(spark, partitions, per_row):
    subs, coms, expected = _random_dump(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = threads.assemble_threads(subs, coms, per_row).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {k: [] for k in expected}
    for r in sorted(rows, key=lambda r: (r["id"], r["segment"])):
        listed = r["top_level_comments"]
        if listed is None:
            assert r["segment"] == 0
            continue
        keys = [((-1 if c["created_utc"] is None else c["created_utc"]), c["id"]) for c in listed]
        assert keys == sorted(keys)
        got[r["id"]] += keys
    assert got == expected  # segments laid end to end are the ordered list
    assert all(len(r["top_level_comments"] or ()) <= per_row for r in rows)
    assert len({(r["id"], r["segment"]) for r in rows}) == len(rows)
    crowded = [r for r in rows if r["id"] == "s7"]
    assert len(crowded) > 1 if per_row < 100 else len(crowded) == 1
    if per_row == 10_000:
        assert len(rows) == len(expected)


def test_threads_without_comments_hold_null(spark):
    subs = clean.clean_submissions(spark.createDataFrame([_sub("a"), _sub("b")], SUB))
    coms = clean.clean_comments(spark.createDataFrame([_com("1", "a")], COM))
    stored = threads.assemble_threads(subs, coms)
    assert {r["id"]: r["top_level_comments"] is None for r in stored.collect()} == {"a": False, "b": True}
    assert threads.explode_comments(stored).count() == 1
    kept = threads.explode_comments(stored, keep_empty=True).where("comment_id is null").collect()
    assert [r["question_id"] for r in kept] == ["b"]


def test_preview_and_heads(spark):
    subs, coms, expected = _random_dump(spark)
    stored = threads.assemble_threads(subs, coms, 20)
    first = sorted(r["id"] for r in subs.collect())[:2]
    wanted = sorted((r["id"], r["segment"]) for r in stored.collect() if r["id"] in first)
    assert [(r["id"], r["segment"]) for r in threads.thread_preview(stored, 2).collect()] == wanted
    some = threads.assemble_threads(*threads.first_threads(subs, coms, 2), 20)
    assert sorted((r["id"], r["segment"]) for r in some.collect()) == wanted
    assert threads.thread_heads(stored).count() == len(expected)


def test_grouping_reuses_the_join_partitioning(spark):
    """No exchange lies between the semi join, the nesting and the outer join on the comment side."""
    subs, coms, _ = _random_dump(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = threads.assemble_threads(subs, coms, 50)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 3
