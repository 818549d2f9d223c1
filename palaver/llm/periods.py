"""Runs of repeated words, by block convolution.

A run is a stretch of words with smallest period q, of at least ``LEAST_WORDS`` words and ``LEAST_TIMES`` periods, that no
neighbouring word extends. At the scale b = 1, 2, 4, ... the words are cut into blocks of b. A run whose period lies in
[b, 2b) holds a whole block together with that block's copy a period later, so every block is compared with all places that
follow it at those distances: the sum of squared differences between the block and each place of the window is
a convolution, taken exactly in integers by a number-theoretic transform. A sum of zero is an occurrence and its
distance a seed. Sums are taken modulo a prime, so none is missed; the words themselves confirm each. Seeds of one
distance in neighbouring blocks are joined and extended word by word to both sides, by less than a block each.

Two exact rules spare work: a block can only recur within a distance if each of its words does (the next place of every
word is known), and a seed inside a run of a period up to b can only be that run again (two periods of a long enough
stretch have a common divisor that is one too).

Words are runs free of blank, tab, line and page breaks, told apart by their bytes, case included.
Null and empty texts have no words and no runs. Long texts are taken whole; memory is about a hundred bytes for each of
the text's words. Rows are independent: repeated rows and null ids keep their rows, an empty table gives none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import slices, text_column

LEAST_WORDS, LEAST_TIMES = 6, 4
#: A prime with roots of unity of order 2^23, and a generator of its multiplicative group.
PRIME, GENERATOR = 998244353, 3
#: Numbers transformed or compared at a time, and words by which an extension proceeds.
AREA, STEP = 1 << 18, 32
_NEVER = np.int64(1) << 40
_P = np.uint64(PRIME)


@lru_cache(maxsize=64)
def _powers(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 * half."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(half, np.uint64)
    done = 1
    while done < half:
        out[done : 2 * done] = out[: min(done, half - done)] * np.uint64(pow(root, done, PRIME)) % _P
        done *= 2
    return out


def ntt(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Transform of each row (its length a power of two); the forward one leaves its output bit-reversed, the inverse takes it so."""
    n = rows.shape[1]
    x = rows.copy()
    halves = [1 << k for k in range(n.bit_length() - 1)]
    for half in halves if inverse else halves[::-1]:
        pairs = x.reshape(len(x), -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        w = _powers(half, inverse)
        if inverse:
            b = b * w % _P
        total, rest = (a + b) % _P, (a + (_P - b)) % _P
        pairs[:, :, 0], pairs[:, :, 1] = total, rest if inverse else rest * w % _P
    return x * np.uint64(pow(n, -1, PRIME)) % _P if inverse else x


def occurrences(blocks: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) where a row's block of b numbers may stand in its window of 2b, for the places 0 to b - 1."""
    n, b = blocks.shape
    blocks, windows = blocks.astype(np.uint64) % _P, windows.astype(np.uint64) % _P
    reverse = np.zeros_like(windows)
    reverse[:, :b] = blocks[:, ::-1]
    products = ntt(ntt(windows) * ntt(reverse) % _P, inverse=True)[:, b - 1 : 2 * b - 1]
    squares = np.zeros((n, 2 * b + 1), np.uint64)
    np.cumsum(windows * windows % _P, axis=1, out=squares[:, 1:])
    own = (blocks * blocks % _P).sum(axis=1, dtype=np.uint64)[:, None]
    apart = (squares[:, b : 2 * b] - squares[:, :b] + own) % _P
    return np.nonzero(apart == products * np.uint64(2) % _P)


def _reach(words: np.ndarray, at: np.ndarray, shift: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``at`` on, forwards or backwards, equal those ``shift`` later."""
    reach = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    steps = way * np.arange(STEP)
    while len(live):
        place = at[live, None] + way * reach[live, None] + steps
        differ = words[place] != words[place + shift[live, None]]
        some = differ.any(axis=1)
        reach[live] += np.where(some, differ.argmax(axis=1), STEP)
        live = live[~some]
    return reach


def runs_of(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, length, period) rows of all runs, by start and period; row d's words are those from ``first[d]`` to ``first[d + 1]``."""
    n = len(words)
    longest = int(np.diff(first).max(initial=0))
    if longest < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    # A number for each word of each text, and how far on the same word comes next.
    words = words.astype(np.int64) + np.repeat(np.arange(len(first) - 1), np.diff(first)) * (int(words.max()) + 1)
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    names = np.empty(n, np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    ahead = np.full(n, _NEVER)
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    most = 1
    while 2 * most * LEAST_TIMES <= longest:
        most *= 2
    pad = STEP + 1
    # Numbers that occur nowhere else stand before and behind.
    padded = np.concatenate([np.full(pad, n + 1), names, np.full(4 * most + 2 * STEP, n)])
    cover = np.zeros(n, np.int64)
    runs: dict[tuple[int, int], int] = {}
    b = 1
    while b <= most:
        blocks = np.flatnonzero(ahead < 2 * b) * b
        blocks = blocks[cover[blocks] < blocks + 3 * b]
        seeds = []
        many = max(1, AREA // (2 * b))
        for k in range(0, len(blocks), many):
            x = blocks[k : k + many]
            mine = padded[pad + x[:, None] + np.arange(b)]
            row, place = occurrences(mine, padded[pad + b + x[:, None] + np.arange(2 * b)])
            x, d = x[row], place + b
            open_ = cover[x] < x + b + d
            row, x, d = row[open_], x[open_], d[open_]
            for j in range(0, len(x), many):
                part = slice(j, j + many)
                equal = (mine[row[part]] == padded[pad + x[part, None] + d[part, None] + np.arange(b)]).all(axis=1)
                seeds.append(np.stack([d[part][equal], x[part][equal]]))
        d, x = np.concatenate(seeds, axis=1) if seeds else np.zeros((2, 0), np.int64)
        if len(d):
            order = np.lexsort((x, d))
            d, x = d[order], x[order]
            fresh = np.concatenate([[True], (np.diff(d) > 0) | (np.diff(x) != b)])
            heads = np.flatnonzero(fresh)
            tails = np.concatenate([heads[1:], [len(d)]]) - 1
            d, x, y = d[heads], x[heads], x[tails] + b
            back = np.concatenate([_reach(padded, pad + x[k : k + AREA // STEP] - 1, d[k : k + AREA // STEP], -1) for k in range(0, len(d), AREA // STEP)])
            forth = np.concatenate([_reach(padded, pad + y[k : k + AREA // STEP], d[k : k + AREA // STEP], 1) for k in range(0, len(d), AREA // STEP)])
            start, end = x - back, y + forth + d
            long = end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * d)
            for s, e, q in zip(start[long].tolist(), end[long].tolist(), d[long].tolist()):
                runs[s, e] = min(q, runs.get((s, e), q))
                np.maximum(cover[s:e], e, out=cover[s:e])
        if len(ahead) % 2:
            ahead = np.append(ahead, _NEVER)
        ahead = ahead.reshape(-1, 2).max(axis=1)
        b *= 2
    found = np.array(sorted((s, q, e - s) for (s, e), q in runs.items()), np.int64).reshape(-1, 3)
    return found[:, [0, 2, 1]]


def _find(batches):
    for batch in slices(batches, "text"):
        texts = [x.as_py().split() for x in batch.column("text")]
        first = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        words = pa.array([w for text in texts for w in text], pa.large_binary()).dictionary_encode()
        runs = runs_of(np.asarray(words.indices, np.int64), first) if len(words) else np.zeros((0, 3), np.int64)
        doc = np.searchsorted(first, runs[:, 0], side="right") - 1
        runs[:, 0] -= first[doc]
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        kept = [b" ".join(x) for x in texts]
        for d in np.unique(doc).tolist():
            stay = np.ones(len(texts[d]), bool)
            for start, length, period in runs[at[d] : at[d + 1]].tolist():
                stay[start + period : start + length] = False
            kept[d] = b" ".join([w for w, s in zip(texts[d], stay.tolist()) if s])
        spans = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans)
        counts = pa.array(np.diff(first))
        yield pa.RecordBatch.from_arrays([batch.column("id"), counts, lists, pa.array(kept, pa.binary())], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text: id, n_words, runs (start, length and period in words, by start), collapsed (UTF-8).

    ``collapsed`` is the text's words joined by one blank, without those that some run holds behind its first period.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), text_column(df, text).alias("text"))
    return rows.mapInArrow(_find, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
