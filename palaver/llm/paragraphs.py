"""Substring dedup by paragraph MinHash banding.

A text's lines are its paragraphs. Units are lines, and stretches of ``RUN`` words of the whole text, whatever its line
ends. The least hash of the shingles of ``RUN // 2`` words in a stretch is its anchor (winnowing): equal stretches have equal
anchors wherever they stand, so all that two texts share lies at anchors that both have. Neighbouring stretches of one anchor
make a segment, about one for every five words, with a hash of all its words. Segments are compared as wholes first: one that a
smaller id has too is marked. Only where an anchor has segments that differ, at the ends of what is shared, the stretches of
one holder of each (the smallest id) are compared word by word. A word is
marked if and only if a stretch around it is in a text of a smaller id (or its line is such a text's near copy).

Lines of five or more words get MinHash bands of their five-word shingles (``ROWS`` values in each of ``BANDS``: 99.7 % of pairs at a
similarity of 0.8 share one) and a sketch of ``MINIMA`` minima, four bits each. In a band, lines are compared with the
most frequent one, then, where that left them in different components, with each other. A pair whose sketches differ in
more than ``APART`` places is none (at a similarity of 0.8 one in five thousand pairs does); on the others the overlap of
their shingles decides inside the join, each pair taken once, in the least band that it shares, so that only similar pairs
leave it, and the texts' exact Jaccard similarity confirms them. Shorter lines are told by a hash of the whole line.
Links make components of lines; in each, the lines of the smallest id stay and those of other ids are marked.
Marked stretches of ``RUN`` words or more are removals, so short phrases
stay. Equal lines are collapsed before banding. Segments are range-partitioned once by (anchor, segment, id), which
spreads a frequent one over tasks; each task marks what a smaller id of its own range has, and hands what it can't tell, the
anchors at a range's edge, to the comparison word by word. Stretches are range-partitioned by (hash, id) in the same way; the hash
at a range's edge is settled with the least id that the edges name.

Null texts are empty. Rows with a null id neither mark nor are marked. A row is known by its id and its text: where an id has
several texts, each has its own removals (``twin``, a hash of the text, tells them apart and is 0 for all other ids), and
they do not mark each other: passages that one id repeats stay. Repeated rows lose the same. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import _powers, mix, slices, text_buffer, text_column, word_hashes, word_spans
from palaver.llm.components import components
from palaver.session import small_side, stage

#: MinHash bands and values in each; least words of a removal.
BANDS, ROWS, RUN = 8, 3, 16
#: Minima in a sketch, the first of which make the bands, and places in which the sketches of a candidate pair may differ.
MINIMA, APART = 64, 24
SHINGLE, SIMILAR = 5, 0.8
_ROW = ["id", "twin"]
_LINES = "id long, twin long, line long, word int, words int, begin int, end int, bands array<long>"
_SEGMENTS = "id long, twin long, anchor long, segment long, words long, bytes long"
_HELD = "id long, twin long, words long, bytes long, open boolean"
_RUNS = "id long, twin long, pairs array<long>, pair_words array<long>, pair_bytes array<long>"
_FACTORS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) + np.uint64(977)) | np.uint64(1)


def _sequences(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number for each run of words, from running sums."""
    up, down = _powers(len(hashes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[:-1])])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _lists_of(values: pa.Array, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)


def _lists(values: np.ndarray, first: np.ndarray, kind) -> pa.ListArray:
    return _lists_of(pa.array(values, kind), first)


def _minima(shingles: np.ndarray, heads: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` minima (a row for each) of each line's shingles; lines begin at ``heads``."""
    return np.stack([np.minimum.reduceat(shingles * f ^ (shingles >> np.uint64(29)) * f, heads) for f in _FACTORS[:n]])


def _banded(least: np.ndarray) -> np.ndarray:
    """A number for each band (a row for each line)."""
    value = least[: BANDS * ROWS].reshape(BANDS, ROWS, -1)
    folded = value[:, 0]
    for r in range(1, ROWS):
        folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + value[:, r])
    return np.ascontiguousarray(mix(folded + np.arange(BANDS, dtype=np.uint64)[:, None]).T).view(np.int64)


def _packed(low: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A beginning and a length, 32 bits each, as one number."""
    return (low.astype(np.int64) << 32) | length.astype(np.int64)


def _sketches(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum (a row for each, a column for each line), sixteen to a number."""
    bits = ((least >> np.uint64(24)) & np.uint64(15)).reshape(-1, 16, least.shape[1])
    return (bits << (4 * np.arange(16, dtype=np.uint64))[:, None]).sum(axis=1, dtype=np.uint64).T


def _taken(batch: pa.RecordBatch, doc: np.ndarray) -> list[pa.Array]:
    """What names the rows ``doc`` of a batch."""
    return [batch.column(c).take(pa.array(doc)) for c in _ROW]


def _units(batches):
    for batch in slices(batches, "text"):
        data, at = text_buffer(batch.column("text"))
        starts, ends, first = word_spans(data, at)
        n = len(starts)
        if not n:
            continue
        hashes = word_hashes(data, starts, ends)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        breaks = np.concatenate([[0], np.cumsum(data == 10)])[starts]
        fresh = np.concatenate([[True], (np.diff(doc) > 0) | (np.diff(breaks) > 0)])
        line = np.flatnonzero(fresh)
        stop = np.concatenate([line[1:], [n]])
        base = at[doc[line]]
        width = stop - line
        wide = np.flatnonzero(width >= SHINGLE)
        if len(wide):
            shingles = _sequences(hashes, np.arange(n - SHINGLE + 1), np.arange(SHINGLE, n + 1))
            inside = np.zeros(len(shingles), bool)
            count = width[wide] - SHINGLE + 1
            place = np.repeat(line[wide] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            inside[place] = True
            own = shingles[inside]
            heads = np.cumsum(count) - count
            kept = np.zeros(len(line), np.int64)
            kept[wide] = 1
            ahead = np.concatenate([[0], np.cumsum(kept)])
            bands = _lists(_banded(_minima(own, heads, BANDS * ROWS)).ravel(), BANDS * ahead, pa.int64())
        else:
            bands = _lists(np.zeros(0, np.int64), np.zeros(len(line) + 1, np.int64), pa.int64())
        word = lambda w: (w - first[doc[np.minimum(w, n - 1)]]).astype(np.int32)  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays(
            [
                *_taken(batch, doc[line]), pa.array(_sequences(hashes, line, stop).view(np.int64)), pa.array(word(line)), pa.array(width.astype(np.int32)),
                pa.array((starts[line] - base).astype(np.int32)), pa.array((ends[stop - 1] - base).astype(np.int32)), bands,
            ],
            [*_ROW, "line", "word", "words", "begin", "end", "bands"],
        )


def _stretches(hashes: np.ndarray, first: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and anchor of every stretch of ``run`` words that lies in one text; ``first`` as in word_spans."""
    count = np.maximum(np.diff(first) - run + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    if not len(doc):
        return doc, doc, np.zeros(0, np.uint64)
    begin = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(len(doc))
    width = max(1, run // 2)
    n = len(hashes) - width + 1
    shingles = _sequences(hashes, np.arange(n), np.arange(n) + width)
    least = shingles[: len(hashes) - run + 1].copy()
    for k in range(1, run - width + 1):
        np.minimum(least, shingles[k : k + len(least)], out=least)
    return doc, begin, least[begin]


def _segments(run: int):
    """A row for each segment of each text: its anchor, a hash of all its words, and its place in words and bytes."""

    def segments(batches):
        for batch in slices(batches, "text"):
            data, at = text_buffer(batch.column("text"))
            starts, ends, first = word_spans(data, at)
            hashes = word_hashes(data, starts, ends)
            doc, begin, anchor = _stretches(hashes, first, run)
            if not len(doc):
                continue
            head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])]))
            tail = np.concatenate([head[1:], [len(doc)]]) - 1
            low, high, mine = begin[head], begin[tail] + run, doc[head]
            words = _packed(low - first[mine], high - low)
            spans = _packed(starts[low] - at[mine], ends[high - 1] - starts[low])
            hashed = [anchor[head].view(np.int64), _sequences(hashes, low, high).view(np.int64)]
            yield pa.RecordBatch.from_arrays([*_taken(batch, mine), *map(pa.array, (*hashed, words, spans))], [*_ROW, "anchor", "segment", "words", "bytes"])

    return segments


def _holders(batches):
    """Of segments in order of (anchor, segment, id): those that a smaller id has, and those still ``open``.

    Open are the segments' first holders at anchors that have several segments and ids, or that reach beyond this batch.
    """
    last = least = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, segment, own = (np.asarray(batch.column(c)) for c in ("anchor", "segment", "id"))
        fresh_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        fresh = fresh_anchor | np.concatenate([[True], segment[1:] != segment[:-1]])
        heads = np.flatnonzero(fresh)
        firsts = own[heads]
        if last == (anchor[0], segment[0]):
            firsts[0] = least  # the segment goes on from the batch before
        leasts = firsts[np.cumsum(fresh) - 1]
        last, least = (anchor[-1], segment[-1]), leasts[-1]
        at = np.flatnonzero(fresh_anchor)
        several = (np.add.reduceat(fresh.astype(np.int64), at) > 1) & (np.minimum.reduceat(own, at) < np.maximum.reduceat(own, at))
        several[[0, -1]] = True
        settled = own > leasts
        open_ = ~settled & several[np.cumsum(fresh_anchor) - 1]
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*_ROW, "words", "bytes")), pa.array(open_)], [*_ROW, "words", "bytes", "open"])
        yield out.filter(pa.array(settled | open_))


def _runs(run: int):
    """The stretches of the segments at ``open`` of each text: a hash of all their words, and their places."""

    def runs(batches):
        for batch in slices(batches, "text"):
            data, at = text_buffer(batch.column("text"))
            starts, ends, first = word_spans(data, at)
            hashes = word_hashes(data, starts, ends)
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("open").value_lengths()))
            opened = np.asarray(batch.column("open").flatten())
            count = (opened & 0xFFFFFFFF) - run + 1
            low = (opened >> 32) + first[doc]
            begin = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            order = np.unique(begin)  # segments of one text may overlap in a repeated row
            doc, begin = np.searchsorted(first, order, side="right") - 1, order
            ahead = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            places = _packed(begin - first[doc], np.full(len(doc), run))
            spans = _packed(starts[begin] - at[doc], ends[begin + run - 1] - starts[begin])
            lists = [_lists(x, ahead, pa.int64()) for x in (_sequences(hashes, begin, begin + run).view(np.int64), places, spans)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, _ROW), *lists], [*_ROW, "pairs", "pair_words", "pair_bytes"])

    return runs


def shared_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(id, twin, words, bytes) of what texts of a smaller id have too, in stretches of ``run`` words or more."""
    segments = docs.mapInArrow(_segments(run), _SEGMENTS).repartitionByRange("anchor", "segment", "id")
    held = stage(segments.sortWithinPartitions("anchor", "segment", "id").mapInArrow(_holders, _HELD), "segments")
    opened = stage(held.where("open").groupBy(*_ROW).agg(F.collect_set("words").alias("open")), "open")
    size = opened.agg(F.sum(F.size("open"))).first()[0] or 0
    runs = docs.join(small_side(opened, size, 1_000_000), _ROW).select(*_ROW, "text", "open").mapInArrow(_runs(run), _RUNS)
    marked = held.where("not open").select(*_ROW, "words", "bytes")
    return marked.union(repeated_pairs(stage(runs, "runs")))


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two lines' sets of five-word shingles (a shorter line: its whole sequence), A-Z in lower case."""
    sets = []
    for words in (a.lower().split(), b.lower().split()):
        sets.append({tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def _sets(batches):
    """Adds ``shingles``, the distinct five-word shingles of each line as 32-bit hashes, its bands and its sketch."""
    for batch in slices(batches, "text"):
        data, at = text_buffer(batch.column("text"))
        starts, ends, first = word_spans(data, at)
        hashes = word_hashes(data, starts, ends)
        n = len(hashes) - SHINGLE + 1
        runs = _sequences(hashes, np.arange(n), np.arange(n) + SHINGLE)
        own = [runs[first[d] : first[d + 1] - SHINGLE + 1] for d in range(batch.num_rows)]
        found = [np.unique(x.astype(np.uint32)) for x in own]
        ahead = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        least = _minima(np.concatenate(own), np.cumsum([0, *map(len, own[:-1])]), MINIMA)
        row = np.arange(batch.num_rows + 1)
        out = batch.append_column("shingles", _lists(np.concatenate(found).view(np.int32), ahead, pa.int32()))
        out = out.append_column("bands", _lists(_banded(least).ravel(), BANDS * row, pa.int64()))
        sketch = np.ascontiguousarray(_sketches(least)).view(np.int64).ravel()
        yield out.append_column("sketch", _lists(sketch, MINIMA // 16 * row, pa.int64()))


def _verify(batches):
    for batch in batches:
        same = [jaccard(x, y) >= SIMILAR for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield batch.filter(pa.array(same, pa.bool_())).select(["a", "b"])


def alike(a: str, b: str) -> Column:
    """Whether two sketches differ in few enough places for the threshold."""
    apart = F.lit(0)
    for i in range(MINIMA // 16):
        x = F.get(a, i).bitwiseXOR(F.get(b, i))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        apart = apart + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return apart <= APART


def similar_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Links (a, b) between hashes of different lines whose similarity reaches the threshold."""
    wide = lines.where(F.size("bands") > 0)
    distinct = wide.groupBy("line").agg(
        F.count("*").alias("n"), F.min_by(F.struct(*_ROW, "begin", "end", "bands"), F.struct(*_ROW)).alias("at")
    )
    distinct = stage(distinct.select("line", "n", "at.*"), "lines")
    banded = distinct.select("line", "n", F.explode("bands").alias("band"))
    most = F.max(F.struct("n", "line")).over(Window.partitionBy("band"))["line"]
    stars = banded.select("band", "line", most.alias("star")).where(F.col("star") != F.col("line"))
    stars = stage(stars, "stars")  # the members of bands that hold several lines, but for the star
    members = stars.select("band", "line").union(stars.select("band", F.col("star").alias("line"))).distinct()
    where = distinct.select("line", *_ROW, "begin", "end").join(members.select("line").distinct(), "line", "left_semi")
    where = stage(where, "where")
    texts = docs.join(small_side(where, where.count(), 200_000), _ROW).select(
        "line", F.substring(F.col("text"), F.col("begin") + 1, F.col("end") - F.col("begin")).alias("text")
    )
    kinds = "line long, text binary, shingles array<int>, bands array<long>, sketch array<long>"
    crowd = stage(texts.dropDuplicates(["line"]).mapInArrow(_sets, kinds), "crowd")

    def side(i: int, *more: str) -> DataFrame:
        return crowd.select(*[F.col(c).alias(f"{c}{i}") for c in ("line", "sketch", *more)])

    def similar() -> Column:
        n, m = F.size("shingles1"), F.size("shingles2")
        shared = F.size(F.array_intersect("shingles1", "shingles2"))
        return (F.least(n, m) >= SIMILAR * F.greatest(n, m)) & alike("sketch1", "sketch2") & (shared * (1 + SIMILAR) >= SIMILAR * (n + m) - 1e-6)

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        pairs = stage(pairs.select("line1", "line2"), label)
        both = pairs.join(crowd.select(F.col("line").alias("line1"), F.col("text").alias("x")), "line1")
        both = both.join(crowd.select(F.col("line").alias("line2"), F.col("text").alias("y")), "line2")
        both = both.select(F.least("line1", "line2").alias("a"), F.greatest("line1", "line2").alias("b"), "x", "y")
        return stage(both.mapInArrow(_verify, "a long, b long"), label)

    first = stars.select(F.least("star", "line").alias("line1"), F.greatest("star", "line").alias("line2")).distinct()
    # One pair at most for each band of a line: the sketches decide which texts are compared.
    links = verified(first.join(side(1), "line1").join(side(2), "line2").where(alike("sketch1", "sketch2")), "stars")
    known = stage(components(links, "lines"), "lines")
    named = members.join(known.withColumnRenamed("v", "line"), "line", "left").select(
        "band", "line", F.coalesce("component", "line").alias("class")
    )
    apart = named.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    left = stage(named.join(apart.select("band"), "band", "left_semi"), "apart")
    one, two = (
        left.select(*[F.col(c).alias(f"{c}{i}") for c in ("band", "line", "class")]).join(side(i, "shingles", "bands"), f"line{i}") for i in (1, 2)
    )
    once = F.array_min(F.array_intersect("bands1", "bands2")) == F.col("band1")
    rest = one.join(two, (F.col("band1") == F.col("band2")) & (F.col("class1") < F.col("class2")) & similar() & once)
    return links.union(verified(rest, "rest"))


def _later_holders(batches):
    """Of occurrences in order of (pair, id), those whose pair a smaller id has.

    ``pair`` is null where a row of this task tells. The first pair's least id may follow on an earlier task's: its rows
    keep their ``pair``. Rows without ``words`` name the first and last pair and the least id that this task saw of them.
    """
    names = [*_ROW, "pair", "words", "bytes"]
    first = last = None
    low = least = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pair, own = np.asarray(batch.column("pair")), np.asarray(batch.column("id"))
        fresh = np.concatenate([[pair[0] != last], pair[1:] != pair[:-1]])
        leasts = np.concatenate([[least], own[fresh]])[np.cumsum(fresh)]
        if first is None:
            first, low = pair[0], own[0]
        settled = own > leasts
        keep = settled | ((pair == first) & (own == low))
        last, least = pair[-1], leasts[-1]
        arrays = [*map(batch.column, _ROW), pa.array(pair, mask=settled), batch.column("words"), batch.column("bytes")]
        yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(keep))
    if first is not None:
        none = pa.nulls(2, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([low, least]), pa.array([0, 0]), pa.array([first, last]), none, none], names)


def repeated_pairs(lines: DataFrame) -> DataFrame:
    """(id, twin, words, bytes) of the stretches that a smaller id has too."""
    zipped = F.arrays_zip(F.col("pairs").alias("pair"), F.col("pair_words").alias("words"), F.col("pair_bytes").alias("bytes"))
    ranges = lines.select(*_ROW, F.inline(zipped)).repartitionByRange("pair", "id").sortWithinPartitions("pair", "id")
    kinds = "id long, twin long, pair long, words long, bytes long"
    later = stage(ranges.select(*_ROW, "pair", "words", "bytes").mapInArrow(_later_holders, kinds), "later")
    edges = stage(later.where("words is null").groupBy("pair").agg(F.min("id").alias("least")), "edges")
    edge = later.where("words is not null").join(small_side(edges, edges.count()), "pair").where(F.col("id") > F.col("least"))
    return later.where("pair is null").select(*_ROW, "words", "bytes").union(edge.select(*_ROW, "words", "bytes"))


def _merge(run: int):
    """Spans of ``run`` words or more from the marks (words, bytes) of each text."""
    high, low = (lambda x: x >> 32), (lambda x: x & 0xFFFFFFFF)

    def merge(batches):
        for batch in batches:
            marks = batch.column("marks")
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(marks.value_lengths()))
            words, places = (np.asarray(x) for x in marks.flatten().flatten())
            order = np.lexsort((words, doc))
            doc, words, places = doc[order], words[order], places[order]
            begin = (doc << 32) + high(words)
            reach = np.maximum.accumulate(begin + low(words))
            heads = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
            tails = np.concatenate([heads[1:], [len(doc)]]) - 1
            length = reach[tails] - begin[heads]
            end = np.maximum.reduceat(high(places) + low(places), heads)
            kept = length >= run
            heads, length, end = heads[kept], length[kept], end[kept]
            texts, first = np.unique(doc[heads], return_index=True)
            at = np.concatenate([first, [len(heads)]])
            fields = [pa.array(x.astype(np.int32)) for x in (high(places[heads]), end)]
            spans = _lists_of(pa.StructArray.from_arrays(fields, ["start", "end"]), at)
            n = np.add.reduceat(length, first) if len(first) else length
            yield pa.RecordBatch.from_arrays([*_taken(batch, texts), spans, pa.array(n)], [*_ROW, "spans", "n_words"])

    return merge


def known_rows(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(id, twin, text) of the rows with an id; ``twin`` tells the texts of one id apart and is 0 where there is one."""
    rows = df.where(F.col(key).isNotNull()).select(*more, F.col(key).cast("long").alias("id"), text_column(df, text).alias("text"))
    marks = rows.select("id", F.xxhash64("text").alias("mark")).groupBy("id").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    several = stage(marks.where("low < high").select("id", F.lit(True).alias("several")), "several")
    twin = F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    kept = rows.columns[: len(more)]
    return rows.join(small_side(several, several.count()), "id", "left").select(*kept, "id", twin.alias("twin"), "text")


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """A row for each text that loses something: id, spans (byte offsets in UTF-8, end exclusive), n_words, twin."""
    return _spans(known_rows(df, key, text), run).select("id", "spans", "n_words", "twin")


def _spans(docs: DataFrame, run: int) -> DataFrame:
    lines = stage(docs.mapInArrow(_units, _LINES), "units")
    short = shared_runs(docs, run)

    packed = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
    whole = lines.select(
        *_ROW, "line", packed(F.col("word"), F.col("words")).alias("words"), packed(F.col("begin"), F.col("end") - F.col("begin")).alias("bytes")
    )
    linked = components(similar_lines(docs, lines), "lines")
    holders = whole.groupBy("line").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    classes = holders.join(linked.withColumnRenamed("v", "line"), "line", "left").select(
        "line", F.coalesce("component", "line").alias("class"), "least", "most"
    )
    classes = stage(classes, "classes")
    firsts = classes.groupBy("class").agg(F.min("least").alias("first"), F.max("most").alias("most")).where("first < most")
    named = stage(classes.join(firsts.select("class", "first"), "class").select("line", "first"), "firsts")
    long = whole.join(small_side(named, named.count()), "line").where(F.col("id") > F.col("first")).select(*_ROW, "words", "bytes")
    marks = short.union(long).groupBy(*_ROW).agg(F.collect_set(F.struct("words", "bytes")).alias("marks"))
    return marks.mapInArrow(_merge(run), "id long, twin long, spans array<struct<start:int,end:int>>, n_words long")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their own columns, texts without repeated passages; untouched texts stay as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = known_rows(docs, key, text, whole)
    spans = stage(_spans(rows.drop("whole"), RUN).select(*_ROW, "spans"), "spans")
    size = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    joined = rows.join(small_side(spans, max(size[0], size[1] or 0)), _ROW, "left")
    removed = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit(b"").alias("kept")),
        lambda acc, s: F.struct(
            s["end"].alias("at"), F.concat(acc["kept"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])).alias("kept")
        ),
        lambda acc: F.concat(acc["kept"], F.substring(F.col("text"), acc["at"] + 1, 1 << 30)),
    )
    cleaned = F.when(F.col("spans").isNull(), F.col("whole")[text]).otherwise(removed.cast("string"))
    cleaned = joined.select(*[(cleaned if c == text else F.col("whole")[c]).alias(c) for c in docs.columns])
    return cleaned.union(docs.where(F.col(key).isNull()))
