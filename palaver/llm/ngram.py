"""Language-model scores by a weighted backoff automaton of word n-grams.

Model: words (A-Z in lower case) and an end after each text. A state is the empty history (the root) or a history of up
to ``order - 1`` words that occurs in training; histories begin with the end of the text before. A state h has an arc
for each word x that followed it in training, with p(x | h) = w * c(h, x) / c(h) + (1 - w) * p(x | h'), and a failure
arc worth 1 - w to h', which is h without its first word; the root has an arc for every word, weighted by the add-one
estimate. The weight w depends on the size of the n-gram and the class of c(h). It is fitted by leave-one-out on all
training tokens, shorter n-grams first. A text is read once from left to right: the state is carried, a word without
an arc takes failure arcs until it finds one, and log-probabilities add up.

The automaton is never whole in one place. Documents become chunks of token numbers with their own vocabulary, written
once. A chunk sends its distinct n-grams, counted, to the buckets their hashes name, as sorted arrays; a bucket adds up
and sends each chunk the totals of just its n-grams, which are the states and arcs the chunk can use. So only distinct
n-grams of a chunk are moved, a frequent n-gram is one number for each chunk, and no task holds more than a bucket or a
chunk. Words are told apart by 64-bit hashes, longer n-grams by their bucket and ``KEY_BITS`` more bits of a hash.

Null texts are empty: one token, the end. A null id counts as empty text when it is drawn to be held out. Repeated rows
are counted and scored as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import follow, slices, text_buffer, text_column, word_hashes, word_spans
from palaver.session import stage

#: Tokens of a chunk, and distinct n-grams aimed at in a bucket.
CHUNK_TOKENS, BUCKET_KEYS = 1_000_000, 1_000_000
#: Classes of c(h) by powers of eight, and the weights tried for each class and size.
CLASSES = 8
WEIGHTS = (0.0, 0.01, 0.04, 0.1, 0.2, 0.35, 0.55, 0.75, 0.9, 0.97)
END = np.uint64(0xE0D0C0B0A0908070)

#: Words of the longest n-grams, and bits of a hash that tell n-grams of one bucket apart.
ORDER, KEY_BITS = 3, 40
#: Tokens that a lane of the walk reads.
LANE = 512

_CHUNK = "chunk long, n long, ids binary, held binary, lengths binary, vocabulary binary, tokens binary"
_COUNTS = "bucket int, chunk long, size int, keys binary, counts binary"
_ANSWER = "chunk long, bucket int, size int, totals binary, known long, total long"
_SCORED = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 7."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's followed by the end, and the number of each text's tokens."""
    data, at = text_buffer(texts)
    starts, ends, first = word_spans(data, at)
    lengths = np.diff(first) + 1
    hashes = np.empty(len(starts) + len(lengths), np.uint64)
    stops = np.cumsum(lengths) - 1
    is_end = np.zeros(len(hashes), bool)
    is_end[stops] = True
    hashes[is_end] = END
    hashes[~is_end] = word_hashes(data, starts, ends)
    return hashes, lengths


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte place by byte place, compressed: the leading places of small ones take almost nothing."""
    places = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(places.tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, kind=np.uint64) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    places = pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(places, np.uint8).reshape(width, n).T).view(kind).ravel()


def _ascending(numbers: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as their differences."""
    return _planes(np.diff(numbers, prepend=np.uint64(0)))


def _sorted_numbers(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data), dtype=np.uint64)


def _chunks(limit: int):
    def chunks(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def chunk():
            nonlocal number, size
            number += 1
            hashes = np.concatenate([x[0] for x in held])
            vocabulary, tokens = np.unique(hashes, return_inverse=True)
            row = {
                "chunk": [number], "n": [len(hashes)],
                "ids": [pa.concat_arrays([x[2] for x in held])], "held": [np.concatenate([x[3] for x in held]).tobytes()],
                "lengths": [np.concatenate([x[1] for x in held]).astype(np.int32).tobytes()],
                "vocabulary": [_ascending(vocabulary)], "tokens": [_planes(tokens.astype(np.uint32))],
            }
            row["ids"] = [pa.record_batch([row["ids"][0]], ["id"]).serialize().to_pybytes()]
            held.clear()
            size = 0
            return pa.RecordBatch.from_pydict(row)

        for batch in slices(batches, "text"):
            hashes, lengths = token_hashes(batch.column("text"))
            if held and size + len(hashes) > limit:
                yield chunk()
            held.append((hashes, lengths, batch.column("id"), np.asarray(batch.column("held").to_numpy(zero_copy_only=False), bool)))
            size += len(hashes)
        if held:
            yield chunk()

    return chunks


_ID = pa.schema([("id", pa.int64())])


class Grams:
    """A chunk's distinct n-grams of one size: key, history, last word, shorter n-gram at the same place, training count."""

    def __init__(self, keys, history, word, shorter, own):
        self.keys, self.history, self.word, self.shorter, self.own = keys, history, word, shorter, own


class Chunk:
    """A chunk's tokens as one stream, in which each text follows an end, and its distinct n-grams of each size."""

    def __init__(self, row: dict, order: int, bits: int):
        self.ids = pa.ipc.read_record_batch(pa.py_buffer(row["ids"]), _ID).column(0)
        self.held = np.frombuffer(row["held"], bool)
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        words = _sorted_numbers(row["vocabulary"])
        self.tokens = _numbers(row["tokens"], np.uint32).astype(np.int64)
        self.document = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.end = int(np.searchsorted(words, END))
        training = ~self.held[self.document]
        place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        own = np.bincount(self.tokens, training, len(words)).astype(np.uint64)
        self.grams = [Grams(words, None, np.arange(len(words)), None, own)]
        hashes, drop = words[self.tokens], np.uint64(max(0, 64 - bits - KEY_BITS))
        keys, number, before, known_before = hashes, self.tokens, END, self.end
        for size in range(2, order + 1):
            keys = follow(np.concatenate([[before], keys[:-1]]), hashes)
            earlier = np.concatenate([[known_before], number[:-1]])
            at = np.flatnonzero(place >= size - 2)  # the n-gram lies in the text and the end before it
            distinct, first, which = np.unique(keys[at] >> drop, return_index=True, return_inverse=True)
            first = at[first]
            own = np.bincount(which, training[at], len(distinct)).astype(np.uint64)
            self.grams.append(Grams(distinct, earlier[first], self.tokens[first], number[first], own))
            number = np.full(len(self.tokens), -1)
            number[at] = which
            before, known_before = np.uint64(0), -1


def _bucket_ends(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Where each bucket, named by the leading bits, begins in the sorted keys of so many bits."""
    if not bits:
        return np.array([0, len(keys)])
    cuts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)
    return np.concatenate([np.searchsorted(keys, cuts), [len(keys)]])


def _send(order: int, bits: int):
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for size, grams in enumerate(Chunk(row, order, bits).grams, 1):
                    ends = _bucket_ends(grams.keys, bits, 64 if size == 1 else min(64, bits + KEY_BITS))
                    some = np.flatnonzero(np.diff(ends))
                    parts = [slice(ends[b], ends[b + 1]) for b in some]
                    yield pa.RecordBatch.from_pydict(
                        {"bucket": pa.array(some, pa.int32()), "chunk": pa.array([row["chunk"]] * len(some), pa.int64()),
                         "size": pa.array([size] * len(some), pa.int32()), "keys": pa.array([_ascending(grams.keys[p]) for p in parts], pa.binary()),
                         "counts": pa.array([_planes(grams.own[p]) for p in parts], pa.binary())}
                    )

    return send


def _add_up(key, rows):
    """Totals of a bucket's n-grams, as an answer to every chunk that sent some."""
    bucket = key[0].as_py()
    sizes = np.asarray(rows.column("size"))
    answers = []
    for size in np.unique(sizes):
        own = rows.take(np.flatnonzero(sizes == size))
        n = own.num_rows
        sent = [_sorted_numbers(k) for k in own.column("keys").to_pylist()]
        counts = np.concatenate([_numbers(c) for c in own.column("counts").to_pylist()])
        distinct, place = np.unique(np.concatenate(sent), return_inverse=True)
        totals = np.bincount(place, counts, len(distinct)).astype(np.uint64)
        ends = np.cumsum([len(k) for k in sent])
        back = [_planes(totals[p]) for p in np.split(place, ends[:-1])]
        answers.append(
            pa.table(
                {"chunk": own.column("chunk"), "bucket": pa.array([bucket] * n, pa.int32()),
                 "size": pa.array([size] * n, pa.int32()), "totals": pa.array(back, pa.binary()),
                 "known": pa.array([int((totals > 0).sum())] + [0] * (n - 1), pa.int64()),
                 "total": pa.array([int(totals.sum())] + [0] * (n - 1), pa.int64())}
            )
        )
    return pa.concat_tables(answers)


def _join(order: int):
    """A chunk beside the totals of its n-grams, one list for each size."""

    def join(key, chunks, answers):
        by_bucket = answers.sort_by([("size", "ascending"), ("bucket", "ascending")])
        sizes = np.asarray(by_bucket.column("size"))
        parts = [_numbers(x) for x in by_bucket.column("totals").to_pylist()]
        lists = [np.concatenate([np.zeros(0, np.uint64), *(p for p, k in zip(parts, sizes) if k == size)]) for size in range(1, order + 1)]
        return chunks.append_column("totals", pa.array([[_planes(x) for x in lists]], pa.list_(pa.binary())))

    return join


def _class(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) // 3, CLASSES - 1)


def _mixed(count, history, weight, lower):
    """p(x | h) from c(h, x), c(h), the weight and p(x | h'); a history that does not occur adds nothing."""
    weight = np.where(history > 0, weight, 0.0)
    return weight * count / np.maximum(history, 1) + (1 - weight) * lower


class Automaton:
    """The states and arcs that a chunk can use.

    States: 0 is the root, the others are n-grams shorter than the order, size by size. ``codes`` holds each arc as
    state * words + word in order, ``logs`` what it is worth and ``goes`` where it leads.
    """

    def __init__(self, chunk: Chunk, totals: list[np.ndarray], weights: list[np.ndarray], known: int, total: int):
        order, self.words = len(totals), len(totals[0])
        first = np.cumsum([0, 1] + [len(t) for t in totals[: order - 1]])  # of the n-grams of each size, as states
        self.failure = np.zeros(first[-1], np.int64)
        self.fails = np.zeros(first[-1])
        chance = (totals[0] + 1) / (total + known + 1)
        words = np.arange(self.words)
        codes, logs = [words], [np.log10(chance)]
        goes = [np.where(totals[0] > 0, first[1] + words, 0)]
        for size in range(2, order + 1):
            grams, weight = chunk.grams[size - 1], weights[size - 2]
            count, history = totals[size - 1], totals[size - 2]
            here = slice(first[size - 1], first[size - 1] + len(history))
            self.fails[here] = np.log10(1 - weight[_class(history)])
            if size > 2:
                self.failure[here] = first[size - 2] + chunk.grams[size - 2].shorter
            before = history[grams.history]
            chance = _mixed(count, before, weight[_class(before)], chance[grams.shorter])
            arcs = np.flatnonzero(count > 0)
            word = grams.word[arcs]
            to = first[size] + arcs if size < order else first[size - 1] + grams.shorter[arcs]
            codes.append((first[size - 1] + grams.history[arcs]) * self.words + word)
            logs.append(np.log10(chance[arcs]))
            goes.append(np.where(word == chunk.end, first[1] + chunk.end, to))
        rank = np.argsort(codes := np.concatenate(codes))
        self.codes, self.logs, self.goes = codes[rank], np.concatenate(logs)[rank], np.concatenate(goes)[rank]

    def walk(self, tokens: np.ndarray, end: int, warm: int, lane: int = LANE) -> np.ndarray:
        """What each token of the stream adds, read from left to right.

        The stream is cut into lanes that are read side by side, each carrying its state. A lane reads the ``warm`` tokens
        before its first one too, as many as a state remembers, so it begins in the state the whole stream would be in.
        """
        lanes = -(-len(tokens) // lane)
        ends = np.full(warm, end)
        stream = np.concatenate([ends, tokens, np.full(lanes * lane - len(tokens), end)])
        begins = np.arange(lanes) * lane
        state = np.zeros(lanes, np.int64)
        added = np.empty((lane, lanes))
        for step in range(warm + lane):
            word = stream[begins + step]
            value = np.zeros(lanes)
            left = np.arange(lanes)
            while len(left):
                at = state[left]
                code = at * self.words + word[left]
                arc = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[arc] == code
                found, arc = left[hit], arc[hit]
                value[found] += self.logs[arc]
                state[found] = self.goes[arc]
                left, at = left[~hit], at[~hit]
                value[left] += self.fails[at]
                state[left] = self.failure[at]
            if step >= warm:
                added[step - warm] = value
        return added.T.ravel()[: len(tokens)]


def _fit(order: int, bits: int, weights: list[np.ndarray], known: int, total: int):
    """Log-probability of all training tokens for each class and weight of the next size, each token left out of its counts."""

    def fit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size = len(weights) + 2
                chunk, totals = Chunk(row, size, bits), [_numbers(x).astype(np.int64) for x in row["totals"]]
                chance = np.maximum(totals[0], 1) / max(1, total + known)
                for grams, count, history, weight in zip(chunk.grams[1:], totals[1:], totals, [*weights, None]):
                    before, count = np.maximum(history[grams.history] - 1, 0), np.maximum(count - 1, 0)
                    place, lower = _class(before), chance[grams.shorter]
                    if weight is not None:
                        chance = _mixed(count, before, weight[place], lower)
                tried = [np.bincount(place, grams.own * np.log10(_mixed(count, before, w, lower)), CLASSES) for w in WEIGHTS]
                yield pa.RecordBatch.from_pydict({"fit": pa.array([np.array(tried).T.ravel()], pa.list_(pa.float64()))})

    return fit


def _score(order: int, bits: int, weights: list[np.ndarray], known: int, total: int):
    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk, totals = Chunk(row, order, bits), [_numbers(x).astype(np.int64) for x in row["totals"]]
                n, base = len(chunk.lengths), np.log10((totals[0] + 1) / (total + known + 1))
                added = Automaton(chunk, totals, weights, known, total).walk(chunk.tokens, chunk.end, order - 1)
                yield pa.RecordBatch.from_pydict(
                    {"id": chunk.ids, "held_out": pa.array(chunk.held), "n_tokens": chunk.lengths.astype(np.int64),
                     "n_known": np.bincount(chunk.document, totals[0][chunk.tokens] > 0, n).astype(np.int64),
                     "base_score": np.bincount(chunk.document, base[chunk.tokens], n),
                     "score": np.bincount(chunk.document, added, n)}
                )

    return score


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Each text's log10 probability: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if order < 2:
        raise ValueError("an automaton with failure arcs needs an order of two or more")
    rows = df.select(F.col(key).cast("long").alias("id"), held_out(F.col(key)).alias("held"), text_column(df, text).alias("text"))
    chunks = stage(rows.mapInArrow(_chunks(chunk_tokens), _CHUNK), "chunks")
    n = chunks.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (n // BUCKET_KEYS).bit_length())
    sent = chunks.mapInArrow(_send(order, bits), _COUNTS)
    answers = stage(sent.groupBy("bucket").applyInArrow(_add_up, _ANSWER), "totals")
    sizes = answers.where("size = 1").agg(F.sum("known"), F.sum("total")).first()
    known, total = (x or 0 for x in sizes)
    joined = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_join(order), f"{_CHUNK}, totals array<binary>")
    joined = stage(joined, "automata")
    weights: list[np.ndarray] = []
    for _ in range(2, order + 1):
        tried = joined.mapInArrow(_fit(order, bits, weights, known, total), "fit array<double>")
        sums = tried.select(F.posexplode("fit").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
        fit = np.zeros(CLASSES * len(WEIGHTS))
        for r in sums.collect():  # one number for each class and weight
            fit[r["at"]] = r["value"]
        weights = [*weights, np.array(WEIGHTS)[fit.reshape(CLASSES, -1).argmax(axis=1)]]
    scored = joined.mapInArrow(_score(order, bits, weights, known, total), _SCORED)
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
