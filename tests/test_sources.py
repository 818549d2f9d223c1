import json
import os

import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.operators import clean
from palaver.sources import jsonl, manifest, tables
from palaver.sources.arrow_ipc import register_arrow_ipc


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(lines) + "\n")
    return str(path)


LINES = [
    '{"id":"a","title":"x","created_utc":1.5,"over_18":true,"score":"7","extra":[1]}',
    "",
    "{bad",
    "[1]",
    '{"id":"b","title":null,"num_comments":3}',
    '{"id":"c","title":"línea\\n😀","author":"z"}',
]


def test_read_jsonl(spark, tmp_path):
    path = _write(tmp_path / "s.jsonl", LINES)
    rows = {r["id"]: r for r in jsonl.read_jsonl(spark, path, clean.RAW_SUBMISSION_SCHEMA).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"]["created_utc"], rows["a"]["over_18"], rows["a"]["score"]) == ("1.5", "true", "7")
    assert rows["b"]["num_comments"] == "3" and rows["b"]["author"] is None
    assert rows["c"]["title"] == "línea\n😀"
    kept = jsonl.read_jsonl(spark, path, clean.RAW_SUBMISSION_SCHEMA, "keep")
    assert sorted(r["_bad_line"] for r in kept.collect() if r["_bad_line"]) == ["[1]", "{bad"]
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, path, clean.RAW_SUBMISSION_SCHEMA, "fail").collect()
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, path, clean.RAW_SUBMISSION_SCHEMA, "ignore")


def test_json_projection_keeps_nulls_and_omits_absent_keys(spark, tmp_path):
    path = _write(tmp_path / "s.jsonl", LINES)
    lines = jsonl.read_lines(spark, path)
    got = [json.loads(r["value"]) for r in jsonl.project_json_keys(lines, ("id", "title", "author", "extra")).collect()]
    expected = [{k: v for k, v in json.loads(line).items() if k in ("id", "title", "author", "extra")} for line in (LINES[0], LINES[4], LINES[5])]
    assert sorted(got, key=lambda r: r["id"]) == sorted(expected, key=lambda r: r["id"])
    plan = jsonl.project_json_keys(lines, ("id",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("map_filter") == 1
    row = jsonl.count_bad_lines(lines).first()
    assert (row["n_lines"], row["n_bad"]) == (5, 2)


def test_scans_can_be_counted(spark, tmp_path):
    path = _write(tmp_path / "s.jsonl", LINES)
    for mode, n in (("drop", 3), ("keep", 5)):
        rows = jsonl.read_jsonl(spark, path, clean.RAW_SUBMISSION_SCHEMA, mode)
        assert rows.count() == n and rows.select(F.lit(1)).count() == n and len(rows.select(F.lit(1)).collect()) == n
    seen = Observation("seen")
    assert jsonl.read_jsonl(spark, path, clean.RAW_SUBMISSION_SCHEMA, observation=seen).count() == 3
    assert seen.get == {"n_lines": 5, "n_bad": 2}
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.read_jsonl(spark, path, clean.RAW_SUBMISSION_SCHEMA, "fail").collect()


def test_repeated_keys_keep_the_last_value(spark, tmp_path):
    lines = ['{"id":"b","n":1,"id":"c","n":null}', '{"x":{"k":[1,null]},"x":{"k":"v"},"id":null}', '{"n":2,"n":3}', '{"id":1,"id":NaN}', '{"id":{"a":1,"a":2}}']
    path = _write(tmp_path / "s.jsonl", lines)
    held = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    try:
        for policy in ("EXCEPTION", "LAST_WIN"):
            spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
            got = [r["value"] for r in jsonl.project_json_keys(jsonl.read_lines(spark, path), ("id", "n", "x")).collect()]
            assert got[:3] == ['{"id":"c","n":null}', '{"id":null,"x":{"k":"v"}}', '{"n":3}'] and len(got) == 3
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", held)
    assert [r["id"] for r in jsonl.read_jsonl(spark, path, clean.RAW_SUBMISSION_SCHEMA).collect()][:2] == ["c", None]
    assert jsonl.count_bad_lines(jsonl.read_lines(spark, path)).first()["n_bad"] == 2


def test_suffixed_path():
    assert jsonl.suffixed_path("/d/x.json") == "/d/x_filtered.json"
    assert jsonl.suffixed_path("/d.e/x", "_s") == "/d.e/x_s"


def test_write_table_conforms(spark, tmp_path):
    df = spark.createDataFrame([(5, [1.0, None], "a", True)], "num_comments_used bigint, embedding array<double>, author string, x boolean")
    tables.write_table(df, str(tmp_path / "t"), tables.STYLE_SCHEMA)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.schema.simpleString() == tables.STYLE_SCHEMA.simpleString()
    assert [f for f in os.listdir(tmp_path / "t") if f.endswith(".zstd.parquet")]


def test_parquet_projection_prunes(spark, sf):
    plan = tables.read_parquet(spark, f"{sf}/documents.parquet", ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_label_filter_is_pushed_down(spark, tmp_path):
    from palaver.operators.answers import valid_questions

    spark.createDataFrame([("a", "t", "Valid")], tables.CLASSIFIED_SCHEMA).write.parquet(str(tmp_path / "c"))
    plan = valid_questions(spark.read.parquet(str(tmp_path / "c")))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,Valid)" in plan and "struct<id:string,label:string>" in plan


NESTED = "id string, n bigint, ok boolean, v array<float>, c array<struct<id:string,ups:bigint>>"


def _nested(spark):
    rows = [(f"i{k}", k if k % 3 else None, k % 2 == 0, [float(k), None], [(f"c{k}", k)] if k % 4 else None) for k in range(60)]
    return spark.createDataFrame(rows, NESTED).repartition(4)


def test_arrow_ipc_roundtrip(spark, tmp_path):
    register_arrow_ipc(spark)
    df, path = _nested(spark), str(tmp_path / "a")
    df.write.format("arrow_ipc").mode("append").save(path)
    back = spark.read.format("arrow_ipc").load(path)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert len([f for f in os.listdir(path) if not f.endswith(".arrow")]) == 1  # the manifest
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".arrow")]
    assert sum(ipc.open_file(f).read_all().num_rows for f in files) == 60

    some = spark.read.format("arrow_ipc").option("columns", "n, id").load(path)
    assert some.columns == ["n", "id"] and some.agg(F.sum("n")).first()[0] == sum(k for k in range(60) if k % 3)

    df.limit(5).write.format("arrow_ipc").mode("append").save(path)
    assert spark.read.format("arrow_ipc").load(path).count() == 65
    df.limit(7).write.format("arrow_ipc").mode("overwrite").save(path)
    assert spark.read.format("arrow_ipc").load(path).count() == 7


def test_arrow_ipc_splits_a_large_file(spark, tmp_path):
    register_arrow_ipc(spark)
    path = str(tmp_path / "one.arrow")
    with ipc.new_file(path, pa.schema([("k", pa.int64())])) as out:
        for at in range(10):
            out.write_batch(pa.record_batch({"k": pa.array(range(at * 100, at * 100 + 100))}))
    df = spark.read.format("arrow_ipc").option("split_bytes", str(os.path.getsize(path) // 4)).load(path)
    assert df.rdd.getNumPartitions() == 5
    assert sorted(r["k"] for r in df.collect()) == list(range(1000))


def test_arrow_ipc_reads_wide_offsets(spark, tmp_path):
    register_arrow_ipc(spark)
    path = str(tmp_path / "wide.arrow")
    item = pa.struct([("id", pa.large_string()), ("ups", pa.int64())])
    table = pa.table(
        {"id": pa.array(["a", None], pa.large_string()), "c": pa.array([[{"id": "x", "ups": 1}], None], pa.large_list(item))}
    )
    with ipc.new_file(path, table.schema, options=ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    df = spark.read.format("arrow_ipc").load(path)
    assert df.schema.simpleString() == "struct<id:string,c:array<struct<id:string,ups:bigint>>>"
    rows = [(r["id"], r["c"] and [tuple(x) for x in r["c"]]) for r in df.collect()]
    assert rows == [("a", [("x", 1)]), (None, None)]


def test_arrow_ipc_failed_write_leaves_nothing(spark, tmp_path):
    register_arrow_ipc(spark)
    path = str(tmp_path / "a")
    bad = spark.range(20).select(F.when(F.col("id") == 13, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("bigint").alias("k"))
    with pytest.raises(Exception):
        bad.write.format("arrow_ipc").mode("append").save(path)
    assert not [f for f in os.listdir(path) if f.endswith(".json")]
    with pytest.raises(Exception, match="no Arrow IPC files"):
        spark.read.format("arrow_ipc").load(path)
    spark.range(5).withColumnRenamed("id", "k").write.format("arrow_ipc").mode("append").save(path)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):
            bad.write.format("arrow_ipc").mode(mode).save(path)
        assert spark.read.format("arrow_ipc").load(path).count() == 5


def test_arrow_ipc_reads_only_what_a_manifest_names(spark, tmp_path):
    register_arrow_ipc(spark)
    path = str(tmp_path / "a")
    os.makedirs(path)

    def foreign(name, n):
        with ipc.new_file(os.path.join(path, name), pa.schema([("k", pa.int64())])) as writer:
            writer.write_table(pa.table({"k": list(range(n))}))

    count = lambda: spark.read.format("arrow_ipc").load(path).count()
    rows = lambda n: spark.range(n).withColumnRenamed("id", "k").write.format("arrow_ipc")
    foreign("other.arrow", 3)
    assert count() == 3
    rows(4).mode("append").save(path)
    assert count() == 7
    foreign("part-of-a-killed-job.arrow", 50)  # written by a task whose job never came to its manifest
    assert count() == 7
    rows(6).mode("append").save(path)
    assert count() == 13
    held = {f: open(os.path.join(path, f), "rb").read() for f in os.listdir(path)}
    rows(2).mode("overwrite").save(path)
    assert count() == 2
    for name, data in held.items():  # as if the job had ended before it cleared up
        with open(os.path.join(path, name), "wb") as out:
            out.write(data)
    assert count() == 2
    rows(0).mode("overwrite").save(path)
    assert count() == 0


def test_arrow_ipc_writes_a_thousand_files(spark, tmp_path):
    register_arrow_ipc(spark)
    path = str(tmp_path / "many")
    spark.range(0, 3000, 1, 1000).withColumnRenamed("id", "k").write.format("arrow_ipc").mode("append").save(path)
    names = os.listdir(path)
    assert len([n for n in names if n.endswith(".arrow")]) == 1000 and len([n for n in names if n.endswith(".json")]) == 1
    assert sorted(r["k"] for r in spark.read.format("arrow_ipc").load(path).collect()) == list(range(3000))


PAGE = """
<a href="https://h.example/d/AskReddit_comments.zst">a</a> <A class='q' HREF=' /x/Tea_Submissions.ZST '>b</A>
<a id=1 href=/x/coffee_and_cake_comments.zst>c</a> <a data-href="/x/no_comments.zst">d</a>
<!-- <a href="/x/hidden_comments.zst">e</a> --> <script>'<a href="/x/js_comments.zst">'</script>
<a href="/x/a&amp;b_submissions.zst">f</a> <a href="/x/other.zst">g</a> <a href="plain_comments.zst">h</a>
<a
  href="/x/tea_comments.zst">i</a> <link href="/x/l_comments.zst"> <a href="/x/tea_comments.zst?x">j</a>
"""


def test_link_manifest(spark):
    pages = spark.createDataFrame([(PAGE,), (None,)], "html string")
    found = manifest.extract_link_manifest(pages)
    assert sorted(tuple(r) for r in found.collect()) == sorted(
        [
            ("https://h.example/d/AskReddit_comments.zst", "askreddit", "comments"),
            ("/x/Tea_Submissions.ZST", "tea", "Submissions"),
            ("/x/coffee_and_cake_comments.zst", "coffee_and_cake", "comments"),
            ("/x/a&b_submissions.zst", "a&b", "submissions"),
            ("/x/tea_comments.zst", "tea", "comments"),
        ]
    )
    assert "askreddit" not in {r["name"] for r in manifest.exclude_names(found).collect()}
    names = spark.createDataFrame([("TEA",)], "name string")
    assert {r["name"] for r in manifest.exclude_names(found, names).collect()} == {"askreddit", "coffee_and_cake", "a&b"}


def test_thread_schema_matches_the_assembled_table(spark):
    from palaver.operators.threads import assemble_threads

    subs = clean.clean_submissions(spark.createDataFrame([], clean.RAW_SUBMISSION_SCHEMA))
    coms = clean.clean_comments(spark.createDataFrame([], clean.RAW_COMMENT_SCHEMA))
    got = assemble_threads(subs, coms).schema
    assert isinstance(got, T.StructType) and got.simpleString() == tables.THREAD_SCHEMA.simpleString()


def test_links_of_real_pages(spark):
    from palaver.sources.manifest import extract_link_manifest

    html = """<a title="a>b" href="/x/One_comments.zst">1</a> <a href="
	/x/Two_submissions.zst
	">2</a> <a class='q' href='/x/Th&#114;ee&#95;comments.zst'>3</a> <a href=/x/four_comments&#x2E;zst>4</a>"""
    found = extract_link_manifest(spark.createDataFrame([(html,)], "html string")).collect()
    assert sorted((r.name, r.kind) for r in found) == [
        ("four", "comments"), ("one", "comments"), ("three", "comments"), ("two", "submissions")
    ]
