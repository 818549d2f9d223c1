"""Repeated passages word by word, and rows of the pipeline that share an id."""

import numpy as np

import corpus_pipeline
from palaver.llm import paragraphs, simhash

STAGE = dict(zip(("language", "copies", "passages", "packing"), (f for _, f in corpus_pipeline.STAGES)))


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(n)]


def marked_words(texts, run):
    """Words of each text that lie in a stretch of ``run`` words that a smaller id has, by loops."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = texts[i].lower().split()
        own = [tuple(w[k : k + run]) for k in range(len(w) - run + 1)]
        out[i] = len({k + j for k, s in enumerate(own) if s in seen for j in range(run)})
        seen.update(own)
    return out


def test_passages_anywhere_go_word_by_word(spark):
    rng = np.random.default_rng(21)
    texts = {}

    def plant(passage, first=" ", then=" "):
        """Two texts with the passage between words of their own, its words joined otherwise in the second."""
        for joint in (first, then):
            ends = [" ".join(words(rng, int(n))) for n in rng.integers(3, 40, 2)]
            texts[len(texts)] = f"{ends[0]} {joint.join(passage)} {ends[1]}"

    for n in [16, 17, 24, 51, 60, 80] * 8:
        plant(words(rng, n))  # no sentence marks
    for n in (90, 150, 300):
        plant(["the"] * n)
        plant([*"ab"] * (n // 2))
    for n in (20, 55, 90):
        passage = words(rng, n)
        texts[len(texts)] = f"x1 {' '.join(passage)} x2"
        texts[len(texts)] = "y1 " + "".join(w + ("\n" if k % 7 == 6 else " ") for k, w in enumerate(passage)) + "y2"
    plant(words(rng, 15))  # too short
    wanted = {i: n for i, n in marked_words(texts, paragraphs.RUN).items() if n}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.id: r for r in paragraphs.repeated_spans(df).collect()}
    assert {i: r.n_words for i, r in found.items()} == wanted
    for i, r in found.items():
        data = texts[i].encode()
        assert sum(len(data[s.start : s.end].split()) for s in r.spans) == wanted[i]


def test_block_of_short_near_copied_lines_goes(spark):
    rng = np.random.default_rng(5)
    lines = [words(rng, n) for n in (8, 2, 9, 4, 12, 3)]
    copies = [x if len(x) < 5 else [*x, "more"] for x in lines]  # four of five shingles and more
    block, copy = ("\n".join(" ".join(x) for x in b) for b in (lines, copies))
    ends = [" ".join(words(rng, 20)) for _ in range(2)]
    df = spark.createDataFrame([(1, f"{ends[0]}\n{block}"), (2, f"{copy}\n{ends[1]}")], "doc_id long, text string")
    got = [(r.id, r.n_words, [tuple(s) for s in r.spans]) for r in paragraphs.repeated_spans(df).collect()]
    assert got == [(2, sum(map(len, copies)), [(0, len(copy))])]


def test_passages_of_many_texts(spark, monkeypatch):
    """Passages that hundreds of texts share, in different words around, and whole copies: to the word, by loops."""
    rng = np.random.default_rng(31)
    shared = [words(rng, n) for n in (18, 33, 60, 120)]
    texts = {}
    for i in range(260):
        parts = [words(rng, int(rng.integers(0, 12)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [shared[int(rng.integers(0, 4))], words(rng, int(rng.integers(0, 6)))]
        texts[i] = " ".join(sum(parts, []))
    texts |= {300 + i: texts[i % 7] for i in range(60)}
    wanted = {i: n for i, n in marked_words(texts, paragraphs.RUN).items() if n}
    df = paragraphs.known_rows(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text")
    for parts in ("1", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            marks = paragraphs.shared_runs(df).collect()  # without near copies of lines
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        found = {}
        for r in marks:
            found.setdefault(r.id, set()).update(range(r.words >> 32, (r.words >> 32) + (r.words & 0xFFFFFFFF)))
        assert {i: len(w) for i, w in found.items()} == wanted


def odd_ids(spark):
    """One id with three texts (two of them near to others), repeated rows, null ids and columns that clash."""
    rng = np.random.default_rng(12)
    text = [" ".join(words(rng, 60)) for _ in range(4)]
    more = " ".join(words(rng, 40))
    rows = [
        (5, text[0]), (5, text[1]), (5, f"{text[2]} {more}"), (6, text[0]), (7, f"{text[3]} {text[1]}"), (8, text[3]), (8, text[3]),
        (None, text[0]), (None, text[0]), (None, None), (9, None), (9, ""), (9, text[2]),
    ]
    made = [(i, t, "en", "s", 1, 2, 3, 4) for i, t in rows]
    columns = "doc_id long, text string, lang string, source string, __own int, __spans int, id int, twin int"
    return spark.createDataFrame(made, columns), rows, text, more


def test_one_id_with_several_texts(spark):
    df, rows, text, more = odd_ids(spark)
    kept = STAGE["copies"](spark, df, "")
    assert kept.columns == df.columns
    got = sorted(map(str, ((r.doc_id, r.text) for r in kept.collect())))
    empty = [t for t in (None, "") if (9, t) in {(r.doc_id, r.text) for r in kept.collect()}]
    assert len(empty) == 1  # null and empty are one text
    wanted = [(5, text[0]), (5, text[1]), (5, f"{text[2]} {more}"), (7, f"{text[3]} {text[1]}"), (8, text[3]), (9, empty[0]), (9, text[2])]
    assert got == sorted(map(str, wanted + [r for r in rows if r[0] is None]))

    cut = STAGE["passages"](spark, df, "")
    assert cut.columns == df.columns and cut.count() == df.count()
    left = sorted(str((r.doc_id, (r.text or "").split())) for r in cut.collect())
    wanted = [(i, (t or "").split()) for i, t in rows]
    wanted[3], wanted[4], wanted[5], wanted[6], wanted[12] = (6, []), (7, text[3].split()), (8, []), (8, []), (9, [])
    assert left == sorted(map(str, wanted))

    for step in ("language", "packing"):
        assert STAGE[step](spark, df, "").count() >= (df.count() if step == "packing" else 0)


def test_near_copies_within_the_radius_go(spark):
    rng = np.random.default_rng(3)
    base = words(rng, 4000)
    near = [*base[:2000], "changed", *base[2001:]]
    apart = (simhash.fingerprints(spark.createDataFrame([(0, " ".join(base)), (1, " ".join(near))], "doc_id long, text string"), "doc_id", "text", 3)).collect()
    bits = ((apart[0].fingerprint ^ apart[1].fingerprint) % (1 << 64)).bit_count()
    df = spark.createDataFrame([(4, " ".join(near)), (2, " ".join(base)), (3, " ".join(words(rng, 90)))], "doc_id long, text string")
    assert bits <= 2 and {r.doc_id for r in STAGE["copies"](spark, df, "").collect()} == {2, 3}
