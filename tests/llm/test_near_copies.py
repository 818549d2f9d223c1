"""Passages and blocks of lines that documents share."""

import numpy as np

from palaver.llm import paragraphs


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
