"""SentencePiece encoding and decoding for merge-type (BPE) models, exactly, by backtracking.

A text is cut between any two characters that stand side by side in no piece: merging never reaches over that place, so
parts encode on their own. Within a part the encoder takes the longest piece that an Aho-Corasick automaton finds at the
current place, keeps it if it is compatible with the piece before it - merging the two pieces' characters anew gives just
these two, for which the merges along their border suffice - and otherwise tries the next shorter one; if none fits, the
place is marked in a bitfield of failed positions and the piece before it is shortened instead. No place is tried twice
for nothing, so the time is linear in the part's length, also in very long ones. A part that begins with two or more
blanks, whose pieces don't merge in the order of their lengths, goes through the same merging directly. Parts that were
seen before come from a bounded table. A character outside the vocabulary becomes its UTF-8 bytes' pieces and is a border
to merges.

Null texts are empty: no ids but the end. Repeated rows stay repeated. An empty table gives no rows.
"""

from __future__ import annotations

import math
import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import slices

#: Parts, and pairs of pieces, remembered by a worker.
REMEMBERED = 400_000
BLANK = "▁"
#: Stands for the end of a text; no text holds it, as it is no character.
END = "\ud800"
#: Characters whose borders are looked up at a time.
BLOCK = 1 << 16
#: The score of a merge that does not come.
NEVER = -math.inf


class PieceEncoder:
    """Encodes with the vocabulary and scores of a model file; the library is used to read it and to decode."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i) for i in range(n)]
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = {p: self.model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = self.model.eos_id()
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece reaches over a word's start; this model can't be cut there")
        self.cut: dict[str, int] = {}  # of each piece that merging reaches, the place of its last merge; a character: 0
        for p in self.ids:
            if self.merge(p, places := [0]) == [p]:
                self.cut[p] = places[-1]
        self.found = ahocorasick.Automaton()
        self.lengths = [len(p) for p in self.pieces]
        self.shorter: list[int | None] = [None] * n
        for p in self.cut:
            self.found.add_word(p, (len(p) - 1, self.ids[p]))
            self.shorter[self.ids[p]] = next((self.ids[p[:i]] for i in range(len(p) - 1, 0, -1) if p[:i] in self.cut), None)
        self.found.make_automaton()
        self.find_borders()
        self.find_neighbours()

    def find_borders(self) -> None:
        """What stands at a piece's first (last) place while it is merged, each with the score of the merge that ends it.

        Only of pieces whose merges go from the best score to the worst, each score being that of one piece only.
        """
        self.begins: dict[str, list[tuple[str, float]]] = {}
        self.ends: dict[str, list[tuple[str, float]]] = {}
        held = Counter(self.scores.values())
        for p in sorted(self.cut, key=len):
            score, at = self.scores[p], self.cut[p]
            a, b = p[:at], p[at:]
            if not at:
                self.begins[p] = self.ends[p] = [(p, NEVER)]
            elif held[score] == 1 and all(x in self.ends and (len(x) == 1 or self.scores[x] > score) for x in (a, b)):
                self.begins[p] = [*self.begins[a][:-1], (a, score), (p, NEVER)]
                self.ends[p] = [*self.ends[b][:-1], (b, score), (p, NEVER)]

    def find_neighbours(self) -> None:
        """Numbers of the characters in the vocabulary (0: others), and a bit for each pair of them: stands in some piece."""
        letters = sorted(p for p in self.ids if len(p) == 1)
        self.number = np.zeros(sys.maxunicode + 1, np.uint16 if len(letters) < 1 << 16 else np.uint32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        number = {c: i for i, c in enumerate(letters, 1)}
        inside = np.zeros(self.letters**2 // 8 + 1, np.uint8)
        both = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        pairs = [number[a] * self.letters + number[b] for a, b in both if a in number and b in number]
        at = np.array(pairs, np.int64)
        np.bitwise_or.at(inside, at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.inside = inside

    def merge(self, text: str, places: list[int] | None = None) -> list[str]:
        """Pieces by the definition: the best-scored neighbours merge first, ties from the left. ``places`` gets each merge's."""
        piece: list[str | None] = list(text)
        left, right = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        scores, heap = self.scores, []
        for i in range(len(text) - 1):
            if (both := text[i : i + 2]) in scores:
                heap.append((-scores[both], i, both))
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            j = right[i] if piece[i] is not None else -1
            if j < 0 or piece[i] + piece[j] != both:
                continue
            piece[i], piece[j] = both, None
            if places is not None:
                places.append(j)
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (new := piece[a] + piece[b]) in scores:
                    heappush(heap, (-scores[new], a, new))
        return [p for p in piece if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of both anew keeps them apart.

        Of the merges inside both, only those at the border between them are done anew, the best score first: whatever
        stands beside it must find no better merge across. Pieces without such an order are merged in full.
        """
        ends, begins, scores = self.ends.get(a), self.begins.get(b), self.scores
        if ends is None or begins is None:
            return self.merge(a + b) == [a, b]
        i = j = 0
        (x, end), (y, begin) = ends[0], begins[0]
        while True:
            across = scores.get(x + y)
            if across is not None and (across > end and across > begin or across == begin > end):
                return False  # of equal merges the one to the left comes first
            if end >= begin:
                if end == NEVER:
                    return True
                i += 1
                x, end = ends[i]
            else:
                j += 1
                y, begin = begins[j]

    def backtrack(self, text: str) -> list[int]:
        """Ids of the pieces of a text whose characters are all in the vocabulary."""
        longest: list[int | None] = [None] * len(text)
        for last, (before, i) in self.found.iter(text):  # ends ascend, so the last match of a start is its longest
            longest[last - before] = i
        open_ = bytearray(b"\xff" * (len(text) // 8 + 1))  # a bit for each place: not failed yet
        pieces, pairs, lengths, shorter = self.pieces, self.pairs, self.lengths, self.shorter
        stop, size = len(text), len(pieces)
        out: list[int] = []
        at, row = 0, -1  # row: where the pairs with the piece before begin
        i = longest[0] if text else None
        while i is not None:
            end = at + lengths[i]
            if open_[end >> 3] >> (end & 7) & 1:
                fits = row < 0 or pairs.get(row + i)
                if fits is None:
                    if len(pairs) >= self.remembered:
                        pairs.clear()
                    fits = pairs[row + i] = self.compatible(pieces[out[-1]], pieces[i])
                if fits:
                    out.append(i)
                    if end == stop:
                        break
                    at, row = end, i * size
                    i = longest[at]
                    continue
            i = shorter[i]
            while i is None and out:
                open_[at >> 3] &= ~(1 << (at & 7)) & 0xFF
                i = out.pop()
                at -= lengths[i]
                row = out[-1] * size if out else -1
                i = shorter[i]
        return out

    def part(self, text: str) -> list[int]:
        """Ids of a part: a text's end, a character outside the vocabulary, or maybe some blanks, then others without a blank."""
        if text.startswith(BLANK * 2):
            return [self.ids[p] for p in self.merge(text)]
        if len(text) == 1 and text not in self.ids:
            return [self.end] if text == END else [self.bytes[b] for b in text.encode()]
        return self.backtrack(text)

    def parts_of(self, texts: list[str]) -> Iterator[str]:
        """The texts, each with a blank before it, cut between any two characters that stand side by side in no piece.

        Each text is followed by a part of its own that stands for its end.
        """
        whole = "".join([BLANK + t.replace(" ", BLANK) + END if t else END for t in texts])
        begin = 0
        for at in range(0, len(whole) - 1, BLOCK):
            some = whole[at : at + BLOCK + 1].encode("utf-32-le", "surrogatepass")
            numbers = self.number[np.frombuffer(some, np.uint32)]
            pairs = numbers[:-1].astype(np.int64) * self.letters + numbers[1:]
            apart = self.inside[pairs >> 3] >> (pairs & 7).astype(np.uint8) & 1 == 0
            for end in (np.flatnonzero(apart) + (at + 1)).tolist():
                yield whole[begin:end]
                begin = end
        if whole:
            yield whole[begin:]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts with their end ids, as the library gives them, one text after the other, and where each begins."""
        known, learn = self.known, self.learn
        ids = np.frombuffer(b"".join([known.get(p) or learn(p) for p in self.parts_of(texts)]), np.int32)
        return ids, np.concatenate([[0], np.flatnonzero(ids == self.end) + 1])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def learn(self, text: str) -> bytes:
        """A part's ids, four bytes each; a short part is remembered."""
        ids = array("i", self.part(text)).tobytes()
        if len(text) <= 64:
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[text] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """A worker's encoder for a model file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of every row, and with ``decoded`` the text that the ids stand for."""

    def run(batches):
        e = encoder(path)
        for batch in slices(batches, "text"):
            ids, at = e.encode_all([t or "" for t in batch.column("text").to_pylist()])
            columns = [batch.column("id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
            if decoded:
                columns.append(pa.array([e.decode(ids[a:b].tolist()) for a, b in zip(at, at[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>" + (", decoded string" if decoded else ""))


def decode_pieces(df: DataFrame, path: str, key: str = "id", ids: str = "ids") -> DataFrame:
    """(id, text) of every row; null ids are no ids."""

    def run(batches):
        e = encoder(path)
        for batch in batches:
            texts = [e.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(F.col(key).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, "id long, text string")
