"""Stand-ins for models, for tests and benchmarks only: they learn nothing.

``HashingEmbedder`` is signed feature hashing (Weinberger et al., 2009);
``keyword_generator`` answers a prompt from a word in it.
"""

from __future__ import annotations

import hashlib

import numpy as np


class HashingEmbedder:
    """Counts words into ``width`` signed buckets chosen by md5."""

    def __init__(self, width: int = 32):
        self.width = width
        self._slots: dict[str, tuple[int, int]] = {}

    def _slot(self, word: str) -> tuple[int, int]:
        slot = self._slots.get(word)
        if slot is None:
            digest = hashlib.md5(word.encode("utf-8")).hexdigest()
            sign = 1 if int(digest[8:10], 16) % 2 == 0 else -1
            slot = (int(digest[:8], 16) % self.width, sign)
            if len(self._slots) < 200_000:
                self._slots[word] = slot
        return slot

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), dtype=np.float64)
        for row, text in zip(out, texts):
            for word in text.split(" "):
                if word:
                    at, sign = self._slot(word)
                    row[at] += sign
        return out


def keyword_generator():
    """A generator whose reply depends on the letters of the question."""

    def generate(chats: list[list[dict]]) -> list[str]:
        replies = []
        for chat in chats:
            question = chat[-1]["content"].lower()
            if "the" in question:
                replies.append("Valid.")
            elif "und" in question:
                replies.append("That is **invalid**!")
            elif "eau" in question:
                replies.append("Invalid")
            else:
                replies.append("I cannot tell.")
        return replies

    return generate
