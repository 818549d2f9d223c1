import hashlib

from pyspark.sql import functions as F

from palaver.functions.text import (
    from_fullname,
    hash_bucket,
    lenient_bool,
    lenient_long,
    min_chars,
    to_fullname,
    utc_text,
)


def _one(spark, values, fn, ddl="s string"):
    df = spark.createDataFrame([(v,) for v in values], ddl)
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_lenient_long(spark):
    cases = {
        "1.9": 1, "-1.9": -1, "1e3": 1000, " 7 ": 7, "+4": 4, ".5": 0, "12.": 12,
        "abc": None, "": None, "NaN": None, "inf": None, "1e30": None, "1.5d": None, None: None, "1,000": None,
    }
    assert _one(spark, list(cases), lenient_long) == list(cases.values())


def test_lenient_bool(spark):
    assert _one(spark, ["true", "True", "false", "1", None], lenient_bool) == [True, False, False, False, False]


def test_prefixes(spark):
    assert _one(spark, ["t3_abc", "abc", "t3_t3_x", "t1_q", None], from_fullname) == ["abc", "abc", "t3_x", "t1_q", None]
    assert _one(spark, ["abc", None], to_fullname) == ["t3_abc", None]


def test_min_chars_counts_code_points(spark):
    got = _one(spark, ["ab", "😀😀", "éx", None], lambda c: min_chars(c, 3))
    assert got == [False, False, True, None]


def test_hash_bucket(spark):
    ids = [f"c{i}" for i in range(50)]
    expected = [int(hashlib.md5(i.encode()).hexdigest()[:8], 16) % 7 for i in ids]
    assert _one(spark, ids, lambda c: hash_bucket(c, 7)) == expected


def test_utc_text_ignores_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert _one(spark, [0, 1700000000, -1, None], utc_text, "s bigint") == [
                "1970-01-01 00:00:00", "2023-11-14 22:13:20", "1969-12-31 23:59:59", None,
            ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
