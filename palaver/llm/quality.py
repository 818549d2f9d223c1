"""Quality scores from random-indexing word vectors and a small neural network.

Units are the byte trigrams of words, a blank on either side included and cases apart, hashed into ``CELLS`` cells. Every unit has
a fixed random index vector, ternary and sparse, drawn from a hash; its context vector is the sum of the index vectors of the
units within ``REACH`` places around it, over the whole corpus: a task adds up its own rows in an array of fixed size and sends
the cells that it met, which Spark sums. A word's vector is the mean of its units' index and context vectors, each of
length one, so that a word has one even if it was never seen. A document is pooled into the mean of its words' vectors and the
mean of the products of neighbouring words' vectors, which tell how alike neighbours are.

A network of two layers is fitted on a bounded sample of about ``SAMPLE_ROWS`` labelled rows (drawn by a hash of the id), of which one in
``HOLD`` only sets the temperature that divides its output, by the least log-loss, so that scores are probabilities. Every row is scored.

Null texts are empty; texts without words pool to zero and score like any such text. Without rows of both labels, every score is the share
of label 1 (one half without labels). Null labels are no labels; a row labelled more than once is fitted with each.
Repeated rows and null ids are scored as they stand. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import mix, slices, text_buffer, text_column, word_spans

#: Cells of units, width and non-zero places of an index vector, and places on either side that are context.
CELLS, WIDTH, PLACES, REACH = 1 << 14, 32, 2, 2
#: Labelled rows a network is fitted on, about; one in so many of them for the temperature; seed of everything random.
SAMPLE_ROWS, HOLD, SEED = 20_000, 5, 42
#: Hidden units, passes over the sample, rows of a step, its length and the weight decay.
HIDDEN, PASSES, STEP_ROWS, RATE, DECAY = 32, 60, 256, 0.01, 1e-4
#: Bytes of text whose contexts are counted, and whose vectors are held, at a time.
COUNTED, HELD = 1 << 20, 1 << 17


def index_codes() -> np.ndarray:
    """For each cell its ``PLACES`` non-zero places; those from ``WIDTH`` on stand for minus one."""
    draw = mix(np.arange(1, CELLS * PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
    return (draw % np.uint64(2 * WIDTH)).astype(np.int64).reshape(CELLS, PLACES)


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of all words' trigrams, the number of each word's, and the first word of each row."""
    starts, ends, first = word_spans(data, at)
    length = ends - starts
    inside = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())
    spaced = np.full(int(length.sum()) + len(length) + 1, 0x20, np.uint32)
    place = np.arange(len(inside)) + np.repeat(np.arange(1, len(length) + 1), length)
    spaced[place] = data[inside]
    code = (spaced[place - 1] << 16) | (spaced[place] << 8) | spaced[place + 1]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64), length, first


def _contexts(batches):
    """The sums of index vectors around each cell over all of a task's rows: cell and ``WIDTH`` sums."""
    codes = index_codes()
    sums = np.zeros(CELLS * 2 * WIDTH, np.int64)
    for batch in slices(batches, "text", COUNTED):
        cell, length, first = units(*text_buffer(batch.column("text")))
        row = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(first)), length)
        for gap in range(1, REACH + 1):
            near = row[gap:] == row[:-gap]
            left, right = cell[:-gap][near], cell[gap:][near]
            for one, other in ((left, right), (right, left)):
                for k in range(PLACES):
                    sums += np.bincount(one * (2 * WIDTH) + codes[other, k], minlength=len(sums))
    table = sums.reshape(CELLS, 2, WIDTH)
    met = np.flatnonzero(table.any(axis=(1, 2)))
    if len(met):
        table = table[met, 0] - table[met, 1]
        names = ["cell", *[f"s{i}" for i in range(WIDTH)]]
        yield pa.RecordBatch.from_arrays([pa.array(met), *[pa.array(table[:, i]) for i in range(WIDTH)]], names)


def unit_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """The vector of every cell (its index vector and its context vector, side by side), from all rows."""
    sums = [f"s{i}" for i in range(WIDTH)]
    parts = df.select(text_column(df, text).alias("text")).mapInArrow(_contexts, ", ".join(f"{c} long" for c in ["cell", *sums]))
    table = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in sums]).toArrow()  # a row for each cell at most
    own, context = np.zeros((CELLS, 2 * WIDTH)), np.zeros((CELLS, WIDTH))
    for code in index_codes().T:
        own[np.arange(CELLS), code] += 1
    own = own[:, :WIDTH] - own[:, WIDTH:]
    cells = np.asarray(table.column("cell"))
    if len(cells):
        context[cells] = np.stack([np.asarray(table.column(c)) for c in sums], axis=1)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return np.hstack([unit(own), unit(context)]).astype(np.float32)


def word_vectors(cell: np.ndarray, length: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean of each word's cells' vectors, scaled to length one."""
    if len(length) == 1:  # which may be very long: its cells are counted first
        sums = (np.bincount(cell, minlength=CELLS) @ vectors)[None]
    else:
        starts = np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        sums = np.zeros((len(length), vectors.shape[1]), np.float32)
        have = np.searchsorted(-length[order], -np.arange(length.max()), side="left")  # words of more than k letters come first
        for k, some in enumerate(have.tolist()):
            sums[:some] += vectors[cell[starts[order[:some]] + k]]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        sums = sums[back]
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def pool(data: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean of its words' vectors, and of the products of neighbouring ones; zero where there is none."""
    cell, length, first = units(data, at)
    n, width = len(at) - 1, vectors.shape[1]
    sums, pairs = np.zeros((n, width)), np.zeros((n, width))
    ends = np.cumsum(length)
    doc, begin, last = 0, 0, None  # the text and word reached, and the word before it in this text
    while begin < len(length):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + HELD, side="right")))
        words = word_vectors(cell[done : ends[end - 1]], length[begin:end], vectors)
        at_word = begin
        while at_word < end:
            doc = int(np.searchsorted(first, at_word, side="right")) - 1
            stop = min(end, int(first[doc + 1]))
            mine = words[at_word - begin : stop - begin]
            sums[doc] += mine.sum(axis=0)
            pairs[doc] += np.einsum("ij,ij->j", mine[1:], mine[:-1])
            if last is not None and at_word > first[doc]:
                pairs[doc] += mine[0] * last
            at_word, last = stop, mine[-1]
        begin = end
    count = np.diff(first)
    return np.hstack([sums / np.maximum(count, 1)[:, None], pairs / np.maximum(count - 1, 1)[:, None]])


class Network:
    """Two layers on standardised inputs; ``temperature`` divides the log-odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.share = float(y.mean()) if len(y) else 0.5
        self.fitted = bool(len(y)) and 0 < self.share < 1
        self.temperature = 1.0
        if not self.fitted:
            return
        random = np.random.default_rng(SEED)
        order = random.permutation(len(y))
        kept = order[: len(y) // HOLD]
        kept = kept if len(set(y[kept])) == 2 else order
        learnt = order[len(y) // HOLD :] if len(set(y[order[len(y) // HOLD :]])) == 2 else order
        self.mean, self.spread = x[learnt].mean(axis=0), x[learnt].std(axis=0) + 1e-2 * x[learnt].std() + 1e-9
        z, t = (x[learnt] - self.mean) / self.spread, y[learnt]
        rare = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
        weight = np.sqrt(rare)  # the rarer label counts somewhat more
        shapes = [(z.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), ()]
        self.parts = [random.normal(0, s[0] ** -0.5, s) if s and i != 1 else np.zeros(s) for i, s in enumerate(shapes)]
        first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        step = 0
        for _ in range(PASSES):
            mixed = random.permutation(len(t))
            for k in range(0, len(t), STEP_ROWS):
                some = mixed[k : k + STEP_ROWS]
                step += 1
                for i, g in enumerate(self._slopes(z[some], t[some], weight[some])):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.parts[i] = self.parts[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8) - RATE * DECAY * self.parts[i]
        self._calibrate(self._odds(x[kept]), y[kept])

    def _slopes(self, z, t, weight):
        w, b, v, c = self.parts
        hidden = np.tanh(z @ w + b)
        error = weight * (1 / (1 + np.exp(-np.clip(hidden @ v + c, -30, 30))) - t) / weight.sum()
        back = np.outer(error, v) * (1 - hidden * hidden)
        return z.T @ back, back.sum(axis=0), hidden.T @ error, error.sum()

    def _odds(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.parts
        return np.tanh((x - self.mean) / self.spread @ w + b) @ v + c

    def _calibrate(self, odds: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the least log-loss, by a grid."""
        grid = np.geomspace(0.25, 20, 120)
        loss = [np.mean(np.logaddexp(0, np.where(y == 1, -odds, odds) / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._odds(x) / self.temperature, -30, 30)))


def held_out(key: Column) -> Column:
    """Whether a document's label is kept from fitting: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _pooled(vectors: np.ndarray, after):
    def run(batches):
        for batch in slices(batches, "text", COUNTED):
            data, at = text_buffer(batch.column("text"))
            yield after(batch, pool(data, at, vectors))

    return run


def fit(rows: DataFrame, vectors: np.ndarray, n: int, sample: int = SAMPLE_ROWS) -> Network:
    """A network fitted on about ``sample`` of the ``n`` rows (id, text binary, label)."""
    share = min(1.0, sample / max(1, n))
    lot = F.xxhash64(F.col("id"), F.lit(SEED)).cast("double") / float(1 << 63)  # even in [-1, 1)
    some = rows.where(lot <= 2 * share - 1)

    def pack(batch, x):
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), lists], ["id", "label", "pooled"])

    found = some.select("id", "label", "text").mapInArrow(_pooled(vectors, pack), "id long, label int, pooled array<double>")
    table = found.toArrow().sort_by([("id", "ascending"), ("label", "ascending")])  # about ``sample`` rows of fixed width
    x = np.asarray(table.column("pooled").combine_chunks().flatten()).reshape(-1, 4 * WIDTH)
    return Network(x, np.asarray(table.column("label"), dtype=np.float64))


def score_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_ROWS
) -> DataFrame:
    """A row for each document: id, held_out, score (the probability of label 1) and predicted (1 from one half on).

    Labels of held-out documents are not read; of the documents, nothing but the text enters a score.
    """
    ids = F.col(key).cast("long").alias("id")
    rows = docs.select(ids, held_out(F.col(key)).alias("held_out"), text_column(docs, text).alias("text"))
    vectors = unit_vectors(docs, text)
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key))).select(ids, F.when(F.col(label) > 0, 1).otherwise(0).alias("label"))
    n = known.count()
    network = fit(rows.where("not held_out").select("id", "text").join(known, "id"), vectors, n, sample)

    def judge(batch, x):
        score = network.score(x)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
            ["id", "held_out", "score", "predicted"],
        )

    return rows.mapInArrow(_pooled(vectors, judge), "id long, held_out boolean, score double, predicted int")
