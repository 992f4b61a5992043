"""Word and window hashes of a batch of texts, by numpy over their UTF-8 bytes.

The word separators are all ASCII, so words can be cut on bytes. The hash of a
word of up to LONG_BYTES bytes is a polynomial over per-byte random values modulo
2**64, read off a running sum; a window's hash is the same over its mixed word
hashes. Such a polynomial is sound for short rows only: two long rows of two
letters can be built that agree under every base, since base**(2**i) - 1 holds
ever more powers of two. So longer words are hashed by BLAKE2b, ``windows`` is for
windows of at most LONG_BYTES words, and whole sequences have a digest of their own
(:func:`sequence_keys`). Each ``Hasher`` seed gives another family.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Texts are handled in groups of about this many bytes (one longer text alone).
CHUNK_BYTES = 1_000_000
# Rows up to this length are hashed by the polynomial.
LONG_BYTES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator: spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, slice) pairs of about ``limit`` bytes each."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def cut_words(texts: pa.Array, lower: bool = False):
    """Bytes, and the document, first and end byte of every word of a null-free string array."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    solid = np.zeros(len(data) + 1, dtype=bool)
    solid[:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a document begins (or all end) here
    edge[offsets] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = solid[:-1]
    first = np.flatnonzero(solid & (~before | edge))
    end = np.flatnonzero(before & (~solid | edge))
    doc = np.searchsorted(offsets, first, side="right") - 1
    return data, doc, first, end


class Hasher:
    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bases = [int(rng.integers(1, 2**61)) * 8 + 5 for _ in range(2)]
        self.tables: list = [None, None]
        self.key = seed.to_bytes(8, "little")

    def _powers(self, which: int, n: int):
        table = self.tables[which]
        if table is None or len(table[0]) < n:
            size = max(n, 1 << 16)
            pair = []
            for base in (self.bases[which], pow(self.bases[which], -1, 1 << 64)):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            table = tuple(pair)
            if n <= 4 * CHUNK_BYTES:  # tables for one enormous text aren't kept
                self.tables[which] = table
        return table

    def _spans(self, which: int, values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = self._powers(which, len(values) + 1)
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:len(values)], out=total[1:])
        return (total[end] - total[first]) * down[first]

    def words(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - first
        value = mix(self._spans(0, self.byte[data], first, end) + size.astype(np.uint64))
        for i in np.flatnonzero(size > LONG_BYTES):
            digest = hashlib.blake2b(data[first[i]:end[i]], digest_size=8, key=self.key).digest()
            value[i] = int.from_bytes(digest, "little")
        return value

    def windows(self, word: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words [first, end) for each pair, at most LONG_BYTES words apart."""
        return mix(self._spans(1, word, first, end) + (end - first).astype(np.uint64))


def sequence_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the SHA-256 of each text's words joined by one space, as two signed numbers."""
    digests = b"".join([hashlib.sha256(b" ".join(t.split())).digest()[:16] for t in texts.cast(pa.binary()).to_pylist()])
    halves = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()
