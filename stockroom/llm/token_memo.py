"""Token ids of whole texts from a bounded memo of their words' ids, in numpy.

For vocabularies whose tokens never span white space, a text's ids are those of
its words in order. A group of texts is cut into words and hashed at once; only
words not met before go to the encoder. The memo is emptied when full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .wordhash import Hasher, cut_words

MEMO_WORDS = 2_000_000
# Longer words are encoded each time and not kept.
MEMO_BYTES = 64


class TokenMemo:
    """``encode`` gives the ids of some words: (number per word, all ids)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = MEMO_WORDS):
        self.encode, self.limit, self.hasher = encode, limit, Hasher(17)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _fetch(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode ``words`` into the pool: (start, size) of each."""
        size, ids = self.encode(words)
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        start = self.used + np.cumsum(size) - size
        self.used += len(ids)
        return start, size

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids per text, all ids) of a null-free string array."""
        data, doc, first, end = cut_words(texts)
        if not len(first):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        value, sample, inverse = np.unique(self.hasher.words(data, first, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(value) > self.limit:
            self._clear()
        place = np.searchsorted(self.keys, value)
        known = np.zeros(len(value), dtype=bool)
        known[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] == value[place < len(self.keys)]
        start, size = np.zeros(len(value), np.int64), np.zeros(len(value), np.int64)
        start[known], size[known] = self.start[place[known]], self.size[place[known]]
        new = np.flatnonzero(~known)
        before = self.used
        long = np.zeros(0, np.int64)
        if len(new):
            raw = data.tobytes()
            a, b = first[sample[new]], end[sample[new]]
            words = [raw[i:j].decode("utf-8", "replace") for i, j in zip(a.tolist(), b.tolist())]
            start[new], size[new] = self._fetch(words)
            keep = new[b - a <= MEMO_BYTES]
            long = new[b - a > MEMO_BYTES]
            self.keys = np.insert(self.keys, place[keep], value[keep])
            self.start = np.insert(self.start, place[keep], start[keep])
            self.size = np.insert(self.size, place[keep], size[keep])
        size, start = size[inverse], start[inverse]
        ends = np.cumsum(size)
        flat = self.pool[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]))]
        counts = np.concatenate([[0], ends])[np.searchsorted(doc, np.arange(len(texts) + 1))]
        if len(long) and self.used > before + (1 << 20):  # what long words left behind in the pool
            self._clear()
        return np.diff(counts), flat
