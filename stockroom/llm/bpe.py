"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols; leaf ``i`` of a segment tree holds the merge rank
of the pair of symbol ``i`` and its right neighbour. The root is the smallest
(rank, position), i.e. the leftmost pair of the lowest rank. A merge changes at
most three leaves, each a logarithmic update, until no pair can be merged. A
word of n symbols so costs O(n log n), also where a text is one enormous word.

The vocabulary file is one of the ``tokenizers`` library, of the kind: BPE with
an end-of-word suffix; NFC, white space and lower case normalised; split by
letters, single digits and other characters; byte-level symbols; no decoder
(tokens are joined by one space). Its path is a parameter; every Python worker
reads it there.

Results for special rows: a null text counts as empty and has no ids; a null
or repeated ``doc_id`` is passed through, each row on its own; other columns
are left out.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_or_empty
from .token_memo import TokenMemo
from .wordhash import chunks

# Encodings of up to twice so many pieces are remembered per worker.
MEMO_ENTRIES = 400_000
# Longer pieces are encoded each time they occur.
MEMO_BYTES = 64

# The vocabulary's own pieces, for lower-case text of ASCII and the Latin-1 letters.
PLAIN = r"[!-;=-~À-ÖØ-öø-ÿ]*"
PLAIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+"


NONE = 1 << 62  # above every rank << 32 | position: no merge


def merge_pairs(symbols: list[int], rank_of: dict[int, int], merged: list[int]) -> list[int]:
    """Merge ``symbols`` until no adjacent pair has a rank.

    ``rank_of`` maps ``left << 32 | right`` to ``rank << 32``; ``merged`` has a rank's symbol.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get = rank_of.get
    level = [get(a << 32 | b, NONE) + i for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
    if min(level) >= NONE:
        return symbols
    size = 1 << (n - 2).bit_length()  # leaves
    level += [NONE] * (size - n + 1)
    levels = [level]
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        levels.append(level)
    tree = [NONE]  # tree[1] is the root, tree[size:] the leaves
    for level in reversed(levels):
        tree += level
    symbols = list(symbols)
    after = list(range(1, n + 1))  # next living symbol; n: none
    before = list(range(-1, n - 1))

    root = tree[1]
    while root < NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        symbol = symbols[i] = merged[root >> 32]
        symbols[j] = -1  # merged away
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            value = get(symbol << 32 | symbols[k], NONE) + i
        else:
            value = NONE
        # the leaves of i, j and the symbol before i change; each walk stops where nothing changes any more
        at = size + i
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            if other < value:
                value = other
            at >>= 1
            if tree[at] == value:
                break
            tree[at] = value
        at = size + j
        if j < n - 1 and tree[at] < NONE:
            value = tree[at] = NONE
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
        h = before[i]
        if h >= 0:
            value = get(symbols[h] << 32 | symbol, NONE) + h
            at = size + h
            if tree[at] != value and (value < NONE or tree[at] < NONE):
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    if other < value:
                        value = other
                    at >>= 1
                    if tree[at] == value:
                        break
                    tree[at] = value
        root = tree[1]
    return [s for s in symbols if s >= 0]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        if said.get("decoder") is not None or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a vocabulary of this kind")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.rank_of, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of[vocab[a] << 32 | vocab[b]] = rank << 32
            self.merged.append(vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + suffix] for x in letters]
        self.plain, self.pieces = re.compile(PLAIN).fullmatch, re.compile(PLAIN_PIECES).findall
        self.byte_of = {x: i for i, x in enumerate(letters)}
        library = Tokenizer.from_file(path)  # its white-space, lower-case and letter rules, for all other text
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memo = TokenMemo(self._encode_words)
        # ids by piece; the older half holds what was met before the last turnover
        self.piece_memo: dict[bytes, bytes] = {}
        self.old_piece_memo: dict[bytes, bytes] = {}

    def _encode_piece(self, piece: bytes) -> bytes:
        found = self.piece_memo.get(piece) or self.old_piece_memo.get(piece)
        if found is None:
            symbols = [self.inner[b] for b in piece]
            symbols[-1] = self.last[piece[-1]]
            found = self.pack(merge_pairs(symbols, self.rank_of, self.merged))
        if len(piece) <= MEMO_BYTES:
            if len(self.piece_memo) >= MEMO_ENTRIES:
                self.old_piece_memo, self.piece_memo = self.piece_memo, {}
            self.piece_memo[piece] = found
        return found

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return array("i", ids).tobytes()

    def _encode_solid(self, solid: str) -> bytes:
        """The ids of a string without ASCII white space."""
        if self.plain(solid):
            return b"".join([self._encode_piece(x.encode()) for x in self.pieces(solid.lower())])
        out = b""
        parts = self.cut_special.split(solid) if self.cut_special else [solid]
        for part in parts:
            if part in self.special:
                out += self.pack([self.special[part]])
                continue
            for piece, _ in self.split(self.normalise(part)):
                out += self._encode_piece(bytes([self.byte_of[x] for x in piece]))
        return out

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = list(map(self._encode_solid, words))
        return np.array([len(x) // 4 for x in got], dtype=np.int64), np.frombuffer(b"".join(got), dtype=np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids per text, all ids) of a null-free string array."""
        return self.memo.ids(texts)

    def decode(self, ids) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_arrays(bpe: Bpe, texts: pa.Array):
    """(first row, number of ids per text, all ids) for each group of texts."""
    for lo, group in chunks(texts):
        yield lo, *bpe.encode(group)


def _ids_batch(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids))


def _decoded(bpe: Bpe, ids: np.ndarray, counts) -> pa.Array:
    at, out = 0, []
    for n in counts:
        out.append(bpe.decode(ids[at:at + n].tolist()))
        at += n
    return pa.array(out, pa.string())


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids array<int>) per row of ``docs`` (doc_id, text)."""

    def run(batches):
        bpe = load(tokenizer_path)
        for batch in batches:
            for lo, counts, ids in encode_arrays(bpe, batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(lo, len(counts)), _ids_batch(ids, counts)], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded string) per row of ``encoded`` (doc_id, ids)."""

    def run(batches):
        bpe = load(tokenizer_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(1)
                texts = _decoded(bpe, lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))
                yield pa.record_batch([*part.columns, texts], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """:func:`decode` of :func:`encode`, in one pass: (doc_id, ids, decoded) per row of ``docs``."""

    def run(batches):
        bpe = load(tokenizer_path)
        for batch in batches:
            for lo, counts, ids in encode_arrays(bpe, batch.column(1)):
                yield pa.record_batch(
                    [batch.column(0).slice(lo, len(counts)), _ids_batch(ids, counts), _decoded(bpe, ids, counts)],
                    names=["doc_id", "ids", "decoded"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
