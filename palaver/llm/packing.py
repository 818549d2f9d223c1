"""Order-preserving packing of token sequences by dynamic programming.

Documents are laid end to end in the table's own order and the line of tokens is cut into windows of at most ``length``
tokens. A cut may fall on a document's end, on a sentence's end, or - where sentences are long - at every 16th token.
The cheapest set of cuts minimises padding plus a penalty for each truncation; the cheapest predecessor of a place lies
in a sliding window of places, whose minimum a monotone queue keeps, so the time is linear. Each task packs its own
documents, a bounded stretch at a time, and carries the last windows of a stretch over into the next. Nothing is
shuffled and only the last window of a task is left part empty. Sequences are numbered by task and place.

Null texts are empty and hold the end id only. Rows with a null id and repeated rows are packed like any other. An
empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import slices

#: Token window, tokens packed at a time, and windows that are carried over.
LENGTH, STRETCH, CARRIED = 1024, 1 << 18, 8
#: Penalties in tokens of padding: for a cut between sentences and within one; the longest stretch without a place to cut.
SENTENCE, WITHIN, FREE = 1, 12, 16

_PIECE = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class ByteEncoder:
    """Ids of a byte-level vocabulary, as the ``tokenizers`` library gives them for its file.

    The same vocabulary as ranks is read by the faster of two libraries; texts that its pattern matcher can't run
    through (extremely long runs of one kind) go to the other one.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.whole = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.ends = np.zeros(self.whole.get_vocab_size() + 1, bool)
        for token, rank in ranks.items():
            shown = token.decode("utf-8", "replace")
            self.ends[rank] = "\n" in shown or shown.rstrip(" \"')]»”").endswith((".", "!", "?", "…", "。"))

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        except BaseException as error:  # a panic of the matcher is no Exception
            if type(error).__name__ != "PanicException" and not isinstance(error, ValueError):
                raise
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[tuple, ByteEncoder] = {}


def encoder(*paths: str) -> ByteEncoder:
    """A worker's encoder, made once."""
    if paths not in _ENCODERS:
        _ENCODERS[paths] = ByteEncoder(*paths)
    return _ENCODERS[paths]


def places(sentence: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a line of tokens may be cut, and the penalty there.

    ``sentence`` marks the tokens that end a sentence, ``ends`` are the document ends, the line's length the last.
    """
    kind = np.zeros(len(sentence) + 1, np.int8)
    kind[1:][sentence] = 1
    kind[ends] = 2
    at = np.flatnonzero(kind)
    gaps = np.diff(np.concatenate([[0], at]))
    extra = (gaps - 1) // FREE
    begins = np.repeat(at - gaps, extra)
    nth = np.arange(len(begins)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    more = begins + nth * FREE
    kind[more] = 3
    at = np.flatnonzero(kind)
    return at, np.array([0, SENTENCE, 0, WITHIN])[kind[at]]


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Cuts (ascending, the last place included) of least padding plus penalties, no window longer than ``length``."""
    spots, costs = at.tolist(), penalty.tolist()
    best, origin = [0] * len(spots), [-1] * len(spots)  # best: cost up to a place, plus the place
    queue = deque([-1])  # places whose best ascends; -1 is the line's beginning
    for j, (spot, cost) in enumerate(zip(spots, costs)):
        while (spots[queue[0]] if queue[0] >= 0 else 0) < spot - length:
            queue.popleft()
        i = queue[0]
        origin[j] = i
        value = best[j] = cost + length + (best[i] if i >= 0 else 0)
        while queue and (best[queue[-1]] if queue[-1] >= 0 else 0) >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(spots) - 1
    while j >= 0:
        cuts.append(spots[j])
        j = origin[j]
    return cuts[::-1]


def _pieces(line: list, ends: np.ndarray, cuts: list[int], first: int) -> tuple[dict, list]:
    """Pieces of the documents on a line that lie before the last cut, and what of the line lies behind it."""
    starts = np.concatenate([[0], ends[:-1]])
    borders = np.unique(np.concatenate([[0], cuts, ends[ends <= cuts[-1]]]))
    begins, stops = borders[:-1], borders[1:]
    doc = np.searchsorted(ends, begins, side="right")
    window = np.searchsorted(cuts, begins, side="right")
    head = np.concatenate([[0], cuts])[window]
    out: dict[str, list] = {"id": [], "start": [], "length": [], "ids": [], "doc_tokens": [], "sequence_id": [], "offset": []}
    for b, e, d, w, h in zip(begins.tolist(), stops.tolist(), doc.tolist(), window.tolist(), head.tolist()):
        own, done, ids, total = line[d]
        origin = int(starts[d])
        out["id"].append(own)
        out["start"].append(done + b - origin)
        out["length"].append(e - b)
        out["ids"].append(ids[b - origin : e - origin].tobytes())
        out["doc_tokens"].append(total)
        out["sequence_id"].append(first + w)
        out["offset"].append(b - h)
    rest = []
    for d in range(int(np.searchsorted(ends, cuts[-1], side="right")), len(line)):
        own, done, ids, total = line[d]
        cut = max(0, cuts[-1] - int(starts[d]))
        rest.append((own, done + cut, ids[cut:], total))
    return out, rest


def pack(
    df: DataFrame, paths: tuple[str, str, str], key: str = "doc_id", text: str = "text", end: int = 0,
    length: int = LENGTH, stretch: int = STRETCH,
) -> DataFrame:
    """A row for each piece: its document, place there, ids (little-endian, 32 bits), sequence and place in it.

    ``paths``: the vocabulary for the ``tokenizers`` library, the same as ranks, and the pattern that splits words.
    """

    def run(batches):
        from pyspark import TaskContext

        e = encoder(*paths)
        number = TaskContext.get().partitionId() << 40
        line: list[tuple] = []  # (id, tokens before, ids, all tokens)
        size = 0

        def settle(last: bool):
            nonlocal line, size, number
            ends = np.cumsum([len(x[2]) for x in line])
            ids = np.concatenate([x[2] for x in line])
            cuts = best_cuts(*places(e.ends[ids], ends), length)
            if not last:
                cuts = cuts[:-CARRIED]
                if not cuts:  # too short a line to settle anything on
                    return
            out, line = _pieces(line, ends, cuts, number)
            number += len(cuts)
            size = sum(len(x[2]) for x in line)
            out = {k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()}
            yield pa.RecordBatch.from_pydict(out)

        due = stretch
        for batch in slices(batches, "text"):
            for own, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(e.encode(t or ""), np.uint32(end))
                line.append((own, 0, ids, len(ids)))
                size += len(ids)
                if size >= due:
                    yield from settle(False)
                    due = size + stretch
        if line:
            yield from settle(True)

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE)
