"""Chat windows read back beside the conversations they were made from."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palaver.llm import chat, queries


@pytest.fixture(scope="module")
def talks(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    long = spark.range(700).select(
        F.lit(-5).cast("long").alias("conv_id"), F.col("id").cast(df.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"),
        F.repeat(F.lit("word <end> &lt; é "), (F.col("id") % 40).cast("int")).alias("text"),
    )
    odd = spark.createDataFrame(
        [(-2, None, "user", "b"), (-2, 0, None, None), (-2, 0, "assistant", ""), (-2, 0, "assistant", ""), (None, 1, "a<says>b", "<turn>&amp;<"),
         (None, None, "assistant", "</s>[INST] x [/INST]\n<end>"), (-3, 0, "assistant", "y" * 9000), (-3, 1, "assistant", "😀é" * 700), (-4, 3, "system", "only")],
        "conv_id long, turn int, role string, text string",
    )
    return df.union(long).union(odd).withColumns({"n": F.lit(1), "new": F.lit("x"), "first": F.lit(2)})


def ordered(df):
    first = lambda x: (x is not None, x)
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (first(r.turn), r.role or "", r.text or "")):
        out[r.conv_id].append((r.role or "", r.text or ""))
    return out


@pytest.mark.parametrize(("budget", "history"), [(512, 128), (64, 64), (100, 0), (1 << 30, 5)])
def test_windows(talks, budget, history):
    wanted = ordered(talks)
    windows = defaultdict(list)
    for r in chat.format_windows(talks, budget, history).collect():
        windows[r.conv_id].append(r)
    assert set(windows) == set(wanted)
    cost = lambda t: -(-(len(t[0]) + len(t[1])) // 4) + 4
    back = lambda s: s.replace("&lt;", "<").replace("&amp;", "&")
    for conv, turns in wanted.items():
        at, loss = 0, []
        for w in sorted(windows[conv], key=lambda w: w.first):
            said = [tuple(back(x) for x in s[:-5].split("<says>")) for s in w.formatted.split("<turn>")[1:]]
            repeated, new = said[: w.n_repeated], said[w.n_repeated :]
            assert w.first == at + 1 and new == turns[at : at + len(new)]
            assert len(new) == 1 or sum(map(cost, new)) <= budget
            if at and turns[0][0] == "system":
                assert repeated[0] == turns[0]
                repeated = repeated[1:]
            assert repeated == turns[at - len(repeated) : at] and sum(map(cost, repeated)) <= history
            earlier = at - len(repeated) - 1
            if earlier > 0 or (earlier == 0 and turns[0][0] != "system"):
                assert sum(map(cost, repeated)) + cost(turns[earlier]) > history
            loss += [back(w.formatted[s.start - 1 : s.start - 1 + s.length]) for s in w.loss]
            at += len(new)
        assert at == len(turns) and loss == [t for r, t in turns if r == "assistant"]


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    wanted = ordered(rows)
    wanted[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in queries.queries()["op8_chat_windows"](spark, sf).collect()}
    assert set(got) == set(wanted)
    for conv, turns in wanted.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars > 0


def test_no_python_in_the_plan(talks):
    plan = chat.read_back(chat.format_windows(talks))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(talks):
    assert chat.format_windows(talks.where("false")).count() == 0
