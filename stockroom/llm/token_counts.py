"""Token counts by a map-side two-tier lookup of pre-token lengths.

A text's tokens are those of its pre-tokens in order, so a document's count is
the sum of its pre-tokens' lengths. Tier one is a compact hash table, broadcast
to all workers, of the lengths of up to FREQUENT pre-tokens, those most frequent
in a bounded sample of the rows; tier two is a bounded cache in each worker, which
learns every other length from the tokenizers library as it meets the pre-token.
Pre-tokens are never shuffled: the sample's summaries are a few rows, and the pass
over the documents is one narrow stage.

The table only saves work. A pre-token that is not in it is encoded exactly, so
neither the sample nor the tables' bounds change a count.

Pre-tokens of plain words (ASCII and the letters of U+00C0 to U+00FF) are cut here, in
numpy over the bytes of a group of texts: letter runs, single digits, runs of
other characters, and the contractions. A word with any other character, or with
``<``, which may begin a special token, is looked up as a whole. A very long text
is counted in segments, cut at white space.

Results for special rows: a null text is empty, 0 bytes and 0 tokens; a null or
repeated ``doc_id`` is passed through, each row on its own; an empty table gives no
rows; other columns are left out.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, text_or_empty
from .wordhash import CHUNK_BYTES, Hasher, chunks

# Bound of the sample that says which pre-tokens are frequent, in rows.
SAMPLE_ROWS = 20_000
# Tasks that summarise the sample; each gives the driver one row.
SAMPLE_TASKS = 8
# Entries of the broadcast table, a power of two; with twice as many slots it holds 1.2 MB.
FREQUENT = 1 << 16
# Lengths that a worker remembers, in each of two generations.
CACHED = 400_000
LIMIT = 2048

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, dtype=np.uint8)
_KIND[33:127] = _OTHER
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
for _lo, _hi in ((65, 91), (97, 123), (0x80, 0xC0)):  # the last: bytes that may follow 0xC3
    _KIND[_lo:_hi] = _LETTER
_KIND[0xC3] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[ord("<")] = _ODD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = re.compile(rb"[\x20\x09-\x0D]")


def cut_pre_tokens(data: np.ndarray, edges: np.ndarray):
    """First and end byte of every pre-token, and ``data`` with its plain words in lower case.

    ``edges``: the first byte of every text and the end of the last. Words that
    aren't plain are one piece each.
    """
    kind = np.full(len(data) + 1, _SPACE, dtype=np.uint8)
    kind[:-1] = _KIND[data]
    high = np.flatnonzero((data >= 0x80) & (data < 0xC0))
    stray = (data[high - 1] != 0xC3) | (data[high] == 0x97) | (data[high] == 0xB7)
    kind[high[stray]] = _ODD
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[edges] = True
    before = np.full(len(data) + 1, _SPACE, dtype=np.uint8)
    before[1:] = kind[:-1]
    first = np.flatnonzero((kind != _SPACE) & ((before == _SPACE) | edge))
    end = np.flatnonzero((before != _SPACE) & ((kind == _SPACE) | edge))
    if not len(first):
        return first, end, data

    odd_before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(kind[:-1] == _ODD, out=odd_before[1:])
    odd = odd_before[end] > odd_before[first]
    lower = _LOWER[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[:] = (kind != before) | (kind == _DIGIT)
    begins[first] = True
    if odd.any():
        mark = np.zeros(len(data) + 1, dtype=np.int8)
        mark[first[odd]] += 1
        mark[end[odd]] -= 1
        inside = np.cumsum(mark, dtype=np.int8) > 0
        lower = np.where(inside[:-1], data, lower)
        begins &= ~inside
        begins[first[odd]] = True
    begins &= kind != _SPACE

    # an apostrophe alone in its run takes s, t, m, d, re, ve or ll from the letters after it
    quote = np.flatnonzero((lower == 0x27) & begins[:-1])
    quote = quote[begins[quote + 1] & (kind[quote + 1] == _LETTER) & ~edge[quote + 1]]
    if len(quote):
        third = np.minimum(quote + 2, len(data))
        a, b = lower[quote + 1], np.append(lower, 0)[third]
        inner = ~begins[third] & (kind[third] == _LETTER)  # in the same run of letters
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = inner & (np.isin(a, np.frombuffer(b"rv", np.uint8)) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        taken = np.where(one, 2, np.where(two, 3, 0))
        quote, taken = quote[taken > 0], taken[taken > 0]
        begins[quote + 1] = False
        rest = quote + taken
        rest = rest[rest < len(data)]
        begins[rest[(kind[rest] == _LETTER) & ~edge[rest]]] = True

    starts = np.flatnonzero(begins)
    word = np.searchsorted(first, starts, side="right") - 1
    ends = np.append(starts[1:], len(data))
    return starts, np.minimum(ends, end[word]), lower


class LengthTable:
    """An open-addressing hash table from pre-token hashes to lengths, as two flat arrays."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        self.bits = max(1, 2 * len(keys) - 1).bit_length()
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.lengths = np.zeros(1 << self.bits, np.uint8)
        mask = (1 << self.bits) - 1
        for key, n in zip(keys.tolist(), lengths.tolist()):
            at = key & mask
            while self.keys[at]:
                at = at + 1 & mask
            self.keys[at], self.lengths[at] = key, n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The length of each key, -1 where it isn't there; a probe goes on while the slot holds another key."""
        out = np.full(len(keys), -1, dtype=np.int64)
        mask = np.uint64((1 << self.bits) - 1)
        open_, at = np.arange(len(keys)), (keys & mask).astype(np.int64)
        while len(open_):
            held = self.keys[at]
            same = held == keys[open_]
            out[open_[same]] = self.lengths[at[same]]
            go_on = ~same & (held != 0)
            open_, at = open_[go_on], (at[go_on] + 1) & int(mask)
        return out


class Counter:
    """Token counts of texts: the broadcast table, then this worker's cache, then the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str("a b'd 12é")] != ["a", "b", "'d", "1", "2", "Ã©"]:
            raise ValueError(f"{path}: its pre-tokens are others than those cut here")
        self.hasher = Hasher(29)
        self.new: dict[int, int] = {}
        self.old: dict[int, int] = {}

    def lengths(self, pieces: list[str]) -> list[int]:
        """The library's number of tokens of each piece."""
        said = self.library.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.bincount(np.array(said.word_ids, dtype=np.int64), minlength=len(pieces)).tolist()

    def pieces(self, texts: pa.Array):
        """Bytes in lower case, edges of the texts, first and end byte and hash of the pre-tokens."""
        edges = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[edges[0]:edges[-1]] if raw is not None else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        first, end, lower = cut_pre_tokens(data, edges)
        key = self.hasher.words(lower, first, end) | np.uint64(1)  # 0 marks an empty slot
        return lower, edges, first, end, key

    def _known(self, keys: np.ndarray) -> np.ndarray:
        new, old = self.new.get, self.old.get
        return np.array([new(k) or old(k, 0) for k in keys.tolist()], dtype=np.int64)

    def learn(self, lower: np.ndarray, first: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The lengths of distinct pre-tokens, from the cache or the library (at least 1, but for removed characters)."""
        out = self._known(keys) - 1  # held as length + 1
        unknown = np.flatnonzero(out < 0)
        if len(unknown):
            raw = lower.tobytes()
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(first[unknown].tolist(), end[unknown].tolist())]
            for lo in range(0, len(words), 5_000):
                out[unknown[lo:lo + 5_000]] = self.lengths(words[lo:lo + 5_000])
            if len(self.new) + len(unknown) > CACHED:
                self.old, self.new = self.new, {}
            self.new.update(zip(keys[unknown].tolist(), (out[unknown] + 1).tolist()))
        return out

    def count(self, texts: pa.Array, table: LengthTable | None) -> np.ndarray:
        """Tokens per text of a null-free string array."""
        lower, edges, first, end, key = self.pieces(texts)
        n = table.find(key) if table is not None else np.full(len(key), -1, dtype=np.int64)
        miss = np.flatnonzero(n < 0)
        if len(miss):
            value, sample, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
            at = miss[sample]
            n[miss] = self.learn(lower, first[at], end[at], value)[inverse]
        total = np.concatenate([[0], np.cumsum(n)])
        return np.diff(total[np.searchsorted(first, edges)])


@functools.lru_cache(maxsize=2)
def load(path: str) -> Counter:
    return Counter(path)


def segments(text: str, limit: int):
    """A long text's parts of about ``limit`` bytes, cut at white space."""
    raw, at = text.encode("utf-8"), 0
    while at < len(raw):
        cut = _SOLID.search(raw, at + limit)
        end = cut.end() if cut else len(raw)
        yield raw[at:end].decode("utf-8")
        at = end


def count_texts(counter: Counter, texts: pa.Array, table: LengthTable | None):
    """(first row, tokens per text) of each group of texts."""
    for lo, group in chunks(texts, CHUNK_BYTES):
        if len(group) == 1 and group.nbytes > 4 * CHUNK_BYTES:
            parts = segments(group[0].as_py(), CHUNK_BYTES)
            yield lo, np.array([sum(int(counter.count(pa.array([p]), table)[0]) for p in parts)], dtype=np.int64)
        else:
            yield lo, counter.count(group, table)


def _summaries(sample: DataFrame, path: str, entries: int) -> DataFrame:
    """Per task of ``sample`` (text), the most frequent pre-tokens: hashes, occurrences and lengths, as binary."""

    def run(batches):
        counter = load(path)
        keys, seen, length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                lower, _, first, end, key = counter.pieces(texts)
                value, at, n = np.unique(key, return_index=True, return_counts=True)
                sizes = counter.learn(lower, first[at], end[at], value)
                both, at, inverse = np.unique(np.concatenate([keys, value]), return_index=True, return_inverse=True)
                seen = np.bincount(inverse, np.concatenate([seen, n]), len(both)).astype(np.int64)
                length = np.concatenate([length, sizes])[at]
                keys = both
                if len(keys) > 16 * entries:  # bounds a task's memory; what leaves is rare
                    top = np.sort(np.argsort(-seen, kind="stable")[:8 * entries])
                    keys, seen, length = keys[top], seen[top], length[top]
        top = np.argsort(-seen, kind="stable")[:entries]
        yield pa.record_batch([pa.array([x[top].astype(kind).tobytes()], pa.binary()) for x, kind in
                               ((keys, "<u8"), (seen, "<i8"), (length, "<i8"))], names=["keys", "seen", "lengths"])

    return sample.mapInArrow(run, "keys binary, seen binary, lengths binary")


def frequent_lengths(docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, entries: int = FREQUENT) -> LengthTable:
    """The table of tier one, from about ``sample_rows`` rows of ``docs`` at most.

    Its pre-tokens have at least two occurrences in the sample and fewer than 256
    tokens. The driver merges SAMPLE_TASKS rows of at most ``entries`` pre-tokens.
    """
    n = docs.count()
    sample = docs.select(text_or_empty().alias("text")).sample(min(1.0, sample_rows / max(1, n)), seed=12)
    sample = stored(sample, "tokens-sample").coalesce(SAMPLE_TASKS)
    rows = _summaries(sample, path, entries).collect()
    keys, seen, lengths = (np.concatenate([np.frombuffer(r[i], kind) for r in rows] or [np.zeros(0, kind)])
                           for i, kind in enumerate(("<u8", "<i8", "<i8")))
    keys, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    seen, lengths = np.bincount(inverse, seen, len(keys)), lengths[at]
    good = np.flatnonzero((seen > 1) & (lengths < 256))
    top = good[np.argsort(-seen[good], kind="stable")[:entries]]
    return LengthTable(keys[top], lengths[top])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, table: LengthTable | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs`` (doc_id, text)."""
    if table is None:
        table = frequent_lengths(docs, path)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        counter, table = load(path), shared.value
        for batch in batches:
            for lo, n in count_texts(counter, batch.column(2), table):
                yield pa.record_batch([batch.column(0).slice(lo, len(n)), batch.column(1).slice(lo, len(n)),
                                       pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
