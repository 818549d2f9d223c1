"""Spelling variants against a plain comparison of all words."""

import zlib
from collections import Counter

import pyarrow as pa
import numpy as np
import pytest
import regex

from palaver.llm import queries, variants


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, times=10):
    """{word: (form, root, n, n_near, form_n)} from all pairs of words."""
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


CASES = {
    "forest": 500, "forrest": 50, "forrrest": 5, "fforrrest": 1, "foresté": 50, "forÉst": 2, "forets": 3, "florest": 500,
    "aaaaaaa": 9, "aaaaaaaa": 90, "aaaaaab": 90, "baaaaaa": 90, "abcdefg": 2, "bacdefg": 2, "x" * 400: 3, "x" * 399: 30, "x" * 399 + "y": 1,
    "zzzzzzz": 4,
}


@pytest.mark.parametrize("shard", [1, 3, 1 << 16])
def test_words_against_all_pairs(spark, shard):
    words = spark.createDataFrame(list(CASES.items()), "word string, n long")
    assert found(variants.spelling_variants(words, shard=shard)) == plain(CASES)


def test_shards_of_equal_vectors_are_cut(spark):
    """Anagrams have one vector: no level of the trie tells them apart."""
    rng = np.random.default_rng(5)
    letters = list("estrnoa")
    counts = {"".join(rng.permutation(letters)) + "".join(rng.permutation(letters))[:1]: int(n) for n in rng.integers(2, 400, 300)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(variants.spelling_variants(words, shard=20)) == plain(counts)


def test_verification_of_pairs():
    a = ["abcdefg", "abcdefg", "abcdefg", "aaaaaaa", "abcdefg", "abcdefg", "x" * 300, "x" * 300, "abcdefg"]
    b = ["abcdefg", "abcdefh", "bacdefg", "aaaaaaaa", "abcdefgh", "bcdefg", "x" * 301, "x" * 299 + "y", "bcdefgh"]
    at = np.arange(len(a))
    got = variants.one_edit(variants.Words(pa.array(a)), at, variants.Words(pa.array(b)), at)
    assert got.tolist() == [is_near(x, y) for x, y in zip(a, b)]


def test_letter_runs(spark, odd, empty):
    rows = [(1, "Straße-STRASSENbahn café's d'accord÷×ÀÉÎõüÿ"), (2, None), (None, "Zwölfzehn zwölf")]
    got = variants.letter_runs(spark.createDataFrame(rows, "doc_id long, text string"), least=5).collect()
    assert sorted((r["id"] or 0, r["word"]) for r in got) == [(0, "zwölf"), (0, "zwölfzehn"), (1, "accord÷×ÀÉÎõüÿ"), (1, "strassenbahn"), (1, "straße")]
    counts = variants.word_counts(variants.letter_runs(odd))
    assert counts.where("word = 'warm'").count() == 0
    assert variants.spelling_variants(counts).count() == counts.count()
    assert variants.spelling_variants(variants.word_counts(variants.letter_runs(empty))).count() == 0


def test_query_against_a_plain_version(spark, sf, docs):
    counts = Counter()
    for doc_id, text in docs.select("doc_id", "text").collect():
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = regex.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = found(queries.queries()["op11_spelling_variants"](spark, sf))
    # All pairs by way of their common neighbours, so that the plain version ends.
    keys = {}
    for w in counts:
        for k in range(len(w)):
            keys.setdefault(w[:k] + "\0" + w[k + 1 :], set()).add(w)
    near = {w: {v for k in range(len(w)) for v in keys[w[:k] + "\0" + w[k + 1 :]]} - {w} for w in counts}
    for w in counts:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            if short in counts:
                near[w].add(short)
                near[short].add(w)
    assert {w: (r[2], r[3]) for w, r in got.items()} == {w: (n, len(near[w])) for w, n in counts.items()}
    for w, (form, root, n, _, form_n) in got.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        assert form == (best if best and counts[best] >= 10 * n else None) and form_n == counts.get(form)
        while got[w][0]:
            w = got[w][0]
        assert root == w
