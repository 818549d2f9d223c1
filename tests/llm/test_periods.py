"""Runs of repeated words against a plain search over all periods."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import periods, queries
from tests.llm.conftest import documents


def plain(words):
    """(start, length, period) of every run: for each period, the maximal stretches in which words that far apart agree."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        k = 0
        while k < n - q:
            j = k
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > k and j - k + q >= max(6, 4 * q):
                found.setdefault((k, j + q), q)
            k = max(j, k + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


part = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)).map(lambda p: p[0] * p[1])
text_words = st.lists(part, max_size=6).map(lambda parts: sum(parts, []))


@settings(max_examples=200, deadline=None)
@given(st.lists(text_words, min_size=1, max_size=4))
def test_runs_are_those_of_a_plain_search(texts):
    first = np.cumsum([0] + [len(t) for t in texts])
    words = np.array(sum(texts, []), np.int64)
    found = periods.runs_of(words, first) if len(words) else np.zeros((0, 3), int)
    want = [(s + int(at), n, q) for t, at in zip(texts, first) for s, n, q in plain(t)]
    assert [tuple(r) for r in found.tolist()] == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6), st.data())
def test_transform_finds_every_occurrence(scale, data):
    b = 1 << scale
    window = np.array(data.draw(st.lists(st.integers(0, 1), min_size=2 * b, max_size=2 * b)))
    block = np.array(data.draw(st.lists(st.integers(0, 1), min_size=b, max_size=b)))
    want = [k for k in range(b) if (window[k : k + b] == block).all()]
    assert periods.occurrences(block[None], window[None])[1].tolist() == want


def test_transform_inverts_itself():
    rows = np.random.default_rng(3).integers(0, periods.PRIME, (5, 64)).astype(np.uint64)
    assert (periods.ntt(periods.ntt(rows), inverse=True) == rows).all()


def test_long_runs_of_large_and_small_periods():
    cycle = np.concatenate([np.zeros(500, np.int64), [1]])
    words = np.tile(cycle, 40)
    found = periods.runs_of(words, np.array([0, len(words)])).tolist()
    assert [0, len(words), 501] in found
    assert sum(q == 1 for _, _, q in found) == 40 and len(found) == 41


def test_odd_rows(odd, empty):
    rows = periods.periodic_runs(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        runs = [(x["start"], x["length"], x["period"]) for x in r["runs"]]
        if r["id"] == 10:
            assert runs == [(0, 1200, 3)] and r["collapsed"] == b"lorem ipsum dolor"
        else:
            assert runs == []
    assert periods.periodic_runs(empty).count() == 0


def test_words_are_told_apart_by_bytes_and_kinds_of_space(spark):
    texts = ["a\tA\x0ba A a\nA a A", "a a a a " * 4, "é é\x0cé é\ré é", "a a a a a"]
    got = {r["id"]: [tuple(x) for x in r["runs"]] for r in periods.periodic_runs(documents(spark, texts)).collect()}
    assert got == {0: [(0, 8, 2)], 1: [(0, 8, 1)], 2: [(0, 6, 1)], 3: []}


def test_query_against_a_plain_version(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.queries()["op12_periodic_runs"](spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words = split(text)
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain(words)
        planted += bool(runs)
        r = got[doc_id]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 5


def test_planting_keeps_null_ids_and_texts(odd):
    rows = queries.with_planted_runs(odd).collect()
    assert len(rows) == odd.count() and all(r["text"] is not None for r in rows)
