"""Spelling variants by a trie of letter frequencies.

A word's frequency vector counts its letters, all and then by groups. One inserted, deleted or replaced letter changes the groups by at
most one surplus and one deficit, so near words are found in a trie whose levels are the successive counts: a depth-first search
follows, from the word's own counts, the children that spend no more than that budget (a longer word allows no deficit, a
shorter one no surplus), and the words at the leaves that it reaches are verified letter by letter.

The trie is spread over tasks. Its top is descended by Spark: a node with more than ``SHARD`` words is opened, its children being
the next group's counts, until every open end is a shard; words go to the shard of their own path, and as queries to every
shard that the budget reaches. The table of opened nodes has at most a row for each level and ``SHARD`` words. Below, a
task builds the trie of one shard and searches it for a block of queries. Shards of equal vectors that are still too large and
crowds of queries are cut into blocks by a hash, so no group is larger than about ``SHARD`` words and as many queries, and nothing
is left out. A task returns one row for each query: how many words are near, and the best of them; pairs never leave it.

Counts are over all rows; equal words are added up before they are shuffled. Null texts have no words, and a null id counts as empty in the draw
of slips. Repeated rows count as often as they occur. Ties between near words go to the smallest in code-point order. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.session import key_table, small_side, stage

#: Letters of a word: A-Z, a-z and the letters from U+00C0 to U+00FF, whose code points are one byte in Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
#: Groups of letters whose counts are the levels of the trie below that of the length; all other letters follow from them.
GROUPS = ("e", "t", "a", "n", "o", "i", "s", "r", "h", "l", "d", "u", "cg", "bmpw")
#: Words of a shard and queries of a block, states of the search and pairs verified at a time.
SHARD, STATES = 1 << 17, 1 << 18
#: Letters of a word that is verified as a row of a table.
NARROW = 32
#: Least code points and occurrences of a word, and how many times as frequent its form must be.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10

_FOUND = "word string, n_near long, best_n long, best string"
_GROUP_OF = np.full(256, len(GROUPS), np.int64)
for _i, _group in enumerate(GROUPS):
    _GROUP_OF[[ord(c) for c in _group]] = _i


def word_counts(rows: DataFrame, word: str = "word") -> DataFrame:
    """(word, n) of all words of at least ``LEAST_LETTERS`` letters that occur ``LEAST_COUNT`` times."""
    kept = rows.where(F.char_length(word) >= LEAST_LETTERS)
    return kept.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """(id, word) of every run of letters of at least ``least``, A-Z in lower case; a shorter one can be no word."""
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.select(F.col(key).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", upper, upper.lower()).alias("word"))


def _level(i: int) -> Column:
    """A word's count at a level of the trie: all its letters, then those of each group."""
    return F.char_length("word") - F.char_length(F.translate("word", GROUPS[i - 1], "")) if i else F.char_length("word")


def _spent(i: int, d: int) -> tuple[int, int]:
    """The surplus and deficit that a difference of d spends at a level. A longer word leaves no deficit, a shorter one no surplus."""
    return (max(d, 0), max(-d, 0)) if i else (max(-d, 0), max(d, 0))


def _crowded(words: DataFrame, shard: int) -> list[DataFrame]:
    """For each level, a table of the trie's nodes that hold more than ``shard`` words, named by their counts."""
    levels = []
    path = F.lit("")
    for i in range(len(GROUPS) + 1):
        nodes = key_table(words.groupBy(path.alias("shard")).count().where(F.col("count") > shard).select("shard", F.lit(True).alias("crowded")), "crowded")
        if nodes.isEmpty():
            break
        levels.append(nodes)
        path = F.concat(path, _level(i).cast("string"), F.lit("."))
    return levels


def _descend(words: DataFrame, levels: list[DataFrame], budget: int) -> DataFrame:
    """(word, n, shard) for every end of the trie's top that a word reaches with a surplus and a deficit of ``budget``."""
    ends = words.select("word", "n", F.lit("").alias("shard"), F.lit(0).alias("more"), F.lit(0).alias("less"))
    for i, nodes in enumerate(levels):
        own = _level(i)
        ways = F.array(
            *[
                F.struct(
                    F.concat("shard", (own + d).cast("string"), F.lit(".")).alias("shard"),
                    (F.col("more") + _spent(i, d)[0]).alias("more"),
                    (F.col("less") + _spent(i, d)[1]).alias("less"),
                    (own + d).alias("count"),
                )
                for d in range(-budget, budget + 1)
            ]
        )
        open_ = F.filter(ways, lambda w: (w["count"] >= 0) & (w["more"] <= budget) & (w["less"] <= budget))
        here = F.array(F.struct("shard", "more", "less", F.lit(0).alias("count")))
        ends = ends.join(nodes, "shard", "left").select("word", "n", F.explode(F.when(F.col("crowded"), open_).otherwise(here)).alias("way"))
        ends = ends.select("word", "n", "way.shard", "way.more", "way.less")
    return ends.select("word", "n", "shard")


class Words:
    """Words as rows of letters, Latin-1 bytes, with their lengths and frequency vectors."""

    def __init__(self, words: pa.Array):
        rows = [w.encode("latin-1") for w in words.to_pylist()]
        self.length = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.letters = np.frombuffer(b"".join(rows), np.uint8)
        # Words of up to ``NARROW`` letters as rows of one width, from the front and from the back.
        narrow = [r if len(r) <= NARROW else b"" for r in rows]
        self.front, self.back = (
            np.frombuffer(b"".join([r[::way].ljust(NARROW, b"\0") for r in narrow]), np.uint8).reshape(-1, NARROW) for way in (1, -1)
        )
        width = len(GROUPS) + 1
        row = np.repeat(np.arange(len(rows)), self.length)
        counts = np.bincount(row * width + _GROUP_OF[self.letters], minlength=len(rows) * width).reshape(-1, width)
        self.vectors = np.column_stack([self.length, counts[:, :-1]])


def one_edit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i of a and word j of b differ by exactly one inserted, deleted or replaced letter."""
    n, m = a.length[i], b.length[j]
    short, gap = np.minimum(n, m), np.abs(n - m)
    out = np.zeros(len(i), bool)
    small = np.maximum(n, m) <= NARROW
    some = np.flatnonzero(small & (gap == 0))
    out[some] = (a.front[i[some]] != b.front[j[some]]).sum(axis=1) == 1
    some = np.flatnonzero(small & (gap == 1))
    # What fills up the shorter word differs from the longer one's letter there, so both ways stop at its length at the latest.
    prefix, suffix = ((x[i[some]] != y[j[some]]).argmax(axis=1) for x, y in ((a.front, b.front), (a.back, b.back)))
    out[some] = prefix + suffix >= short[some]
    for k in np.flatnonzero(~small & (gap <= 1)).tolist():
        x, y = (w.letters[w.at[p[k]] : w.at[p[k] + 1]] for w, p in ((a, i), (b, j)))
        w = short[k]
        front, back = x[:w] != y[:w], x[::-1][:w] != y[::-1][:w]
        prefix, suffix = (int(d.argmax()) if d.any() else w for d in (front, back))
        out[k] = prefix + suffix >= w if gap[k] else prefix + suffix == w - 1
    return out


class Trie:
    """The distinct vectors of words as levels of children: node and count name a child by its place."""

    def __init__(self, words: Words):
        self.words = words
        self.order = np.lexsort(words.vectors.T[::-1])
        sorted_ = words.vectors[self.order]
        self.base = int(sorted_.max(initial=0)) + 2
        node = np.zeros(len(sorted_), np.int64)
        self.children = []
        for level in range(sorted_.shape[1]):
            keys, node = np.unique(node * self.base + sorted_[:, level], return_inverse=True)
            self.children.append(keys)
        self.first = np.searchsorted(node, np.arange(len(self.children[-1]) + 1))

    def _down(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.children[level]
        wanted = node * self.base + count
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return place, (keys[place] == wanted) & (count >= 0) & (count < self.base)

    def leaves(self, vectors: np.ndarray):
        """Depth first over blocks of states: (query, leaf) arrays of all leaves within a surplus and a deficit of one."""
        n = len(vectors)
        zero = np.zeros(n, np.int64)
        todo = [(0, np.lexsort(vectors.T[::-1]), zero, zero, zero)]  # in order, as neighbours go through the same nodes
        while todo:
            level, query, node, more, less = todo.pop()
            if level == len(self.children):
                yield query, node
                continue
            parts = []
            for d in (-1, 0, 1):
                more_, less_ = _spent(level, d)
                can = np.flatnonzero((more + more_ < 2) & (less + less_ < 2)) if d else np.arange(len(query))
                child, there = self._down(level, node[can], vectors[query[can], level] + d)
                can = can[there]
                parts.append((query[can], child[there], more[can] + more_, less[can] + less_))
            joined = [np.concatenate(x) for x in zip(*parts)]
            for k in range(0, len(joined[0]), STATES):
                todo.append((level + 1, *(x[k : k + STATES] for x in joined)))

    def near(self, queries: Words):
        """(query, word) arrays of all near pairs."""
        for query, leaf in self.leaves(queries.vectors):
            many = self.first[leaf + 1] - self.first[leaf]
            reach = np.cumsum(many)
            begin = 0
            while begin < len(query):
                done = reach[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(reach, done + STATES, side="right")))
                some, step = query[begin:end], many[begin:end]
                i = np.repeat(some, step)
                j = self.order[np.repeat(self.first[leaf[begin:end]] - (np.cumsum(step) - step), step) + np.arange(step.sum())]
                same = one_edit(queries, i, self.words, j)
                yield i[same], j[same]
                begin = end


def _search(queries: pa.Table, words: pa.Table) -> pa.Table:
    """For each query with near words among ``words``: how many, and the most frequent one."""
    words = words.sort_by("word")  # UTF-8 order is code-point order
    n = np.asarray(words.column("n"))
    asked = queries.column("word").combine_chunks()
    own = Words(asked)
    parts = list(Trie(Words(words.column("word").combine_chunks())).near(own)) if len(n) else []
    i, j = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((j, -n[j], i))
    i, j = i[order], j[order]
    heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else i
    counts = np.diff(np.concatenate([heads, [len(i)]]))
    best = j[heads]
    return pa.table(
        {"word": asked.take(pa.array(i[heads])), "n_near": pa.array(counts, pa.int64()), "best_n": pa.array(n[best]),
         "best": words.column("word").take(pa.array(best))}
    )


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """For each of the words (word, n) that has near ones: word, n_near, best (the most frequent one) and best_n."""
    levels = _crowded(words, shard)

    def blocks(ends: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        ends = stage(ends, name)
        sizes = ends.groupBy("shard").count().select("shard", F.ceil(F.col("count") / shard).cast("int").alias(f"{name}s"))
        return ends, stage(sizes, name)

    (own, cuts), (asked, salts) = blocks(_descend(words, levels, 0), "block"), blocks(_descend(words, levels, 1), "salt")
    sizes = cuts.join(salts, "shard")
    sizes = stage(sizes, "shards")
    sizes = small_side(sizes, sizes.count())
    pick = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["shard", "block", "salt"]
    own = own.join(sizes, "shard").withColumn("block", pick("blocks")).withColumn("salt", each("salts")).select("word", "n", *keys)
    asked = asked.join(sizes, "shard").withColumn("salt", pick("salts")).withColumn("block", each("blocks")).select("word", *keys)
    found = asked.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(_search, _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.best").alias("best"), (-F.col("best.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last word that following the forms leads to. Every round doubles the way."""
    step = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        later = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(step.join(later, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not step.where("moved").isEmpty()
        step = step.select("word", "root")
        if not moved:
            return step


def spelling_variants(counts: DataFrame, times: int = TIMES, shard: int = SHARD) -> DataFrame:
    """For each of the words (word, n): form, root, n, n_near and form_n.

    A word's form is its most frequent near word, if that is ``times`` as frequent as the word itself; its root is the
    last word reached by following forms, or the word itself. Counts grow by ``times`` (more than one) at each step, so it ends.
    """
    words = stage(counts, "words")
    near = near_words(words, shard)
    is_form = F.col("best_n") >= times * F.col("n")
    named = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    named = stage(named, "forms")
    led = roots(named.where("form is not null"))
    return named.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
