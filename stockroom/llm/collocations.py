"""Phrase collocation mining with counting quotient filters.

Texts are cut into blocks of words once. A block is a row: its words as numbers of
its own, and the dictionary of those numbers. Words with fewer than ``least``
occurrences can't be part of a phrase that counts, so only the others get numbers of
the whole corpus; a block gets them back through its dictionary, so tokens are never
shuffled and no dictionary of the corpus is broadcast.

An n-gram is its word numbers side by side in a word of fixed width: two numbers
for pairs, four for longer phrases. An invertible permutation (a Feistel network over the two halves) spreads
these evenly. The leading bits of the result are the quotient, the bits after them
the full remainder: a counting quotient filter keeps per quotient how many
remainders it has, the remainders in order and a counter of each, so nothing is
lost, and the permutation turned back gives the n-gram. Every block makes the sorted
filter of its n-grams, sliced by leading bits; the slices of all blocks are merged by
adding the counters of equal entries, in several levels where the slices are many,
and what reaches ``least`` is decoded. Pairs come first. The phrases of three and four
words are counted only where all their pairs may be frequent, by a bitmap of BITMAP
bits whatever the corpus; a bit set by another pair costs work and changes nothing.

Scores, the test against longer phrases and the ranking are DataFrame joins on
exact whole numbers.

Results for special rows: a null text is empty; a null ``lang`` is ``und``; every row
counts, also repeated ones and those with null or repeated ids; an empty table, or one
with no phrase that occurs often enough, gives no rows; other columns are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import number_rows
from .common import small_side, stored, text_or_empty
from .wordhash import CHUNK_BYTES, Hasher, chunks, mix

LEAST = 30
MOST_WORDS = 4
TOP = 2000
# A phrase goes if a longer one that holds it has this share of its occurrences, in percent.
INSIDE = 80
# Text in a block, about; entries in a merged slice, on average at most; slices a task writes, as bits.
BLOCK_BYTES = 8_000_000
SLICE_ENTRIES = 2_000_000
LEVEL_BITS = 8
# Bits of the bitmap of frequent pairs, as a power of two: 8 MB.
BITMAP = 26

_GAP, _BREAK, _WORD = range(3)
_KIND = np.full(256, _WORD, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = _BREAK
_BREAKS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_hasher = Hasher(41)


# ---- blocks -------------------------------------------------------------------------------


class Block:
    """Words of some texts as numbers from 1 (0 between pieces), and what the numbers stand for."""

    def __init__(self):
        self.number: dict[int, int] = {}
        self.langs: dict[str, int] = {}
        self.words: list[str] = []
        self.lang_of: list[str] = []
        self.stream: list[np.ndarray] = []
        self.bytes = 0

    def add(self, langs: list[str], texts: pa.Array) -> None:
        edges = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        if raw is None or edges[0] == edges[-1]:
            return
        data = _LOWER[np.frombuffer(raw, dtype=np.uint8)[edges[0]:edges[-1]]]
        edges = edges - edges[0]
        self.bytes += len(data)
        kind = _KIND[data]
        solid = np.zeros(len(data) + 1, dtype=bool)
        solid[:-1] = kind == _WORD
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[edges] = True
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = solid[:-1]
        first = np.flatnonzero(solid & (~before | edge))
        end = np.flatnonzero(before & (~solid | edge))
        if not len(first):
            return
        doc = np.searchsorted(edges, first, side="right") - 1
        piece = np.cumsum(kind == _BREAK)[first]
        apart = np.ones(len(first), dtype=bool)
        apart[1:] = (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])

        code = np.array([self.langs.setdefault(x, len(self.langs) + 1) for x in langs], dtype=np.uint64)
        key = mix(_hasher.words(data, first, end) + mix(code)[doc])
        value, sample, inverse = np.unique(key, return_index=True, return_inverse=True)
        numbers = np.array([self.number.get(k, 0) for k in value.tolist()], dtype=np.uint32)
        new = np.flatnonzero(numbers == 0)
        numbers[new] = np.arange(len(self.words) + 1, len(self.words) + 1 + len(new))
        self.number.update(zip(value[new].tolist(), numbers[new].tolist()))
        whole = data.tobytes()
        self.words += [whole[a:b].decode("utf-8", "replace") for a, b in
                       zip(first[sample[new]].tolist(), end[sample[new]].tolist())]
        self.lang_of += [langs[d] for d in doc[sample[new]].tolist()]
        out = np.zeros(len(first) + int(apart.sum()), dtype="<u4")
        out[np.arange(len(first)) + np.cumsum(apart)] = numbers[inverse]
        self.stream.append(out)

    def row(self, block: int) -> pa.RecordBatch:
        stream = np.concatenate(self.stream)
        seen = np.bincount(stream, minlength=len(self.words) + 1)[1:]
        words = pa.StructArray.from_arrays([pa.array(self.lang_of, pa.string()), pa.array(self.words, pa.string()),
                                            pa.array(seen, pa.int64())], names=["lang", "word", "seen"])
        words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        return pa.record_batch([pa.array([block], pa.int64()), pa.array([stream.tobytes()], pa.binary()), words],
                               names=["block", "stream", "words"])


def segments(raw: bytes, limit: int):
    """Parts of about ``limit`` bytes of a long text, cut after the ends of pieces."""
    at = 0
    while at < len(raw):
        cut = _BREAKS.search(raw, at + limit)
        end = cut.end() if cut else len(raw)
        yield raw[at:end].decode("utf-8", "replace")
        at = end


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, stream, words array<struct<lang, word, seen>>): the words of ``docs`` (lang, text) in blocks."""

    def run(batches):
        part, n, block = TaskContext.get().partitionId(), 0, Block()
        for batch in batches:
            for lo, texts in chunks(batch.column(1), CHUNK_BYTES):
                langs = batch.column(0).slice(lo, len(texts)).to_pylist()
                if len(texts) == 1 and texts.nbytes > 4 * CHUNK_BYTES:
                    groups = (pa.array([x]) for x in segments(texts[0].as_py().encode("utf-8"), CHUNK_BYTES))
                else:
                    groups = (texts,)
                for group in groups:
                    block.add(langs, group)
                    if block.bytes >= BLOCK_BYTES and block.words:
                        yield block.row(part << 24 | n)
                        n, block = n + 1, Block()
        if block.words:
            yield block.row(part << 24 | n)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "block long, stream binary, words array<struct<lang:string,word:string,seen:long>>")


def coded_blocks(blocks: DataFrame, entries: DataFrame, words: DataFrame) -> DataFrame:
    """(block, stream) with the numbers of ``words`` (lang, word, id); 0 for rare words and between pieces."""
    own = entries.select("block", "local", "lang", "word").join(words.select("lang", "word", "id"), ["lang", "word"])
    lexicon = own.groupBy("block").agg(F.collect_list(F.struct("local", "id")).alias("pairs"))
    lexicon = stored(lexicon.select("block", F.col("pairs.local").alias("local"), F.col("pairs.id").alias("id")),
                     "collocations-lexicon")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                stream = np.frombuffer(batch.column(1)[i].as_py(), dtype="<u4")
                local = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                id_of = np.zeros(int(stream.max()) + 1, dtype="<u4")
                id_of[local] = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                yield pa.record_batch([batch.column(0).slice(i, 1), pa.array([id_of[stream].tobytes()], pa.binary())],
                                      names=["block", "stream"])

    rows = blocks.select("block", "stream").join(lexicon, "block")
    return stored(rows.mapInArrow(run, "block long, stream binary"), "collocations-coded")


# ---- counting quotient filters -------------------------------------------------------------

FILTER = "slice long, source long, quotient_bits int, runs binary, remainders binary, more binary, counts binary, large binary"
_KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0x3C6EF372FE94F82B, 0xDAA66D2C7DDF743F, 0x78DDE6E5FD29F055)]


def _shifted(x: np.ndarray, bits: int) -> np.ndarray:
    """``x`` >> ``bits``, also by all 64."""
    return x >> np.uint64(bits) if bits < 64 else np.zeros_like(x)


class Permutation:
    """An invertible permutation of pairs of numbers, each below 2**half."""

    def __init__(self, half: int):
        self.mask = np.uint64((1 << half) - 1)

    def apply(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for a, b in (_KEYS[:2], _KEYS[2:]):
            left = left ^ mix(right + a) & self.mask
            right = right ^ mix(left + b) & self.mask
        return left, right

    def undo(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for a, b in (_KEYS[2:], _KEYS[:2]):
            right = right ^ mix(left + b) & self.mask
            left = left ^ mix(right + a) & self.mask
        return left, right


def _to_bytes(x: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)]).tobytes()


def _from_bytes(raw: bytes, n: int, bits: int) -> np.ndarray:
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :-(-bits // 8)] = np.frombuffer(raw, dtype=np.uint8).reshape(n, -(-bits // 8))
    return wide.view("<u8").ravel().astype(np.uint64)


def added(left: np.ndarray, right: np.ndarray, count: np.ndarray):
    """The entries in order, the counts of equal ones added."""
    order = np.lexsort((right, left))
    left, right, count = left[order], right[order], count[order]
    new = np.ones(len(left), dtype=bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(new)
    return left[at], right[at], np.add.reduceat(count, at) if len(at) else count


def encode(left: np.ndarray, right: np.ndarray, count: np.ndarray, half: int, prefix: int) -> tuple:
    """The filter of sorted entries that agree in the first ``prefix`` bits of ``left``: all but slice and source.

    Per quotient the number of its remainders; the remainders, in one number where
    they fit; a byte per counter, 255 for those that follow in full.
    """
    rest = half - prefix
    bits = min(rest, max(0, len(left).bit_length() - 1))
    inner = left & np.uint64((1 << rest) - 1)
    runs = np.bincount(_shifted(inner, rest - bits).astype(np.int64), minlength=1 << bits)
    low = inner & np.uint64((1 << (rest - bits)) - 1)
    if rest - bits + half <= 64:
        remainders, more = _to_bytes(low << np.uint64(half) | right if rest > bits else right, rest - bits + half), b""
    else:
        remainders, more = _to_bytes(low, rest - bits), _to_bytes(right, half)
    large = count >= 255
    return (bits, runs.astype("<u2").tobytes(), remainders, more, np.where(large, 255, count).astype(np.uint8).tobytes(),
            count[large].astype("<i8").tobytes())


def decode(slice_: int, bits: int, runs: bytes, remainders: bytes, more: bytes, counts: bytes, large: bytes,
           half: int, prefix: int):
    """The entries of a filter, in order."""
    rest = half - prefix
    count = np.frombuffer(counts, dtype=np.uint8).astype(np.int64)
    count[count == 255] = np.frombuffer(large, dtype="<i8")
    runs_ = np.frombuffer(runs, dtype="<u2")
    quotient = np.repeat(np.arange(len(runs_), dtype=np.uint64), runs_)
    if rest - bits + half <= 64:
        both = _from_bytes(remainders, len(count), rest - bits + half)
        low, right = _shifted(both, half), both & np.uint64((1 << half) - 1)
    else:
        low, right = _from_bytes(remainders, len(count), rest - bits), _from_bytes(more, len(count), half)
    left = low if rest - bits == 64 else quotient << np.uint64(rest - bits) | low
    return left if rest == 64 else np.uint64(slice_ << rest) | left, right, count


def _sliced(left, right, count, half: int, prefix: int, source: int) -> pa.RecordBatch:
    """Sorted entries as one filter per slice of ``prefix`` leading bits."""
    of = _shifted(left, half - prefix).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    rows = [(int(of[a]), source, *encode(left[a:b], right[a:b], count[a:b], half, prefix))
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(of)])]
    kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    names = [x.split()[0] for x in FILTER.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class Shape:
    """Widths of n-grams: bits of a word number, word numbers in a half, and leading bits that tell the slices apart."""

    def __init__(self, largest_id: int, occurrences: int, in_half: int):
        self.id_bits, self.in_half = max(1, int(largest_id).bit_length()), in_half
        if self.id_bits > 32:
            raise ValueError("more than 2**32 frequent words")
        self.half = in_half * self.id_bits
        slices = max(1, -(-occurrences // SLICE_ENTRIES))
        self.occurrences, self.slice_bits = occurrences, min(self.half, (slices - 1).bit_length())


def _decoded(table: pa.Table, half: int, prefix: int):
    parts = [decode(*row, half, prefix) for row in zip(*(table.column(c).to_pylist() for c in (
        "slice", "quotient_bits", "runs", "remainders", "more", "counts", "large")))]
    return [np.concatenate(x) for x in zip(*parts)]


def block_filters(coded: DataFrame, shape: Shape, grams) -> DataFrame:
    """The filters of every block, sliced; ``grams`` gives a stream's packed n-grams and their counts."""
    permutation, prefix = Permutation(shape.half), min(shape.slice_bits, LEVEL_BITS)

    def run(batches):
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left, right, count = grams(np.frombuffer(raw, dtype="<u4").astype(np.uint64))
                entries = added(*permutation.apply(left, right), count)
                yield _sliced(*entries, shape.half, prefix, block)

    return coded.mapInArrow(run, FILTER)


def _recut(half: int, prefix: int, finer: int, batches: int):
    def recut(table: pa.Table) -> pa.Table:
        source = table.column("source")[0].as_py() % batches
        return pa.Table.from_batches([_sliced(*added(*_decoded(table, half, prefix)), half, finer, source)])

    return recut


def merged(filters: DataFrame, shape: Shape, least: int) -> DataFrame:
    """(ids array<long>, a): the n-grams with ``least`` occurrences in all ``filters``."""
    half, prefix = shape.half, min(shape.slice_bits, LEVEL_BITS)
    while prefix < shape.slice_bits:
        # slices still too large: merged in batches of sources, and cut further
        finer = min(shape.slice_bits, prefix + LEVEL_BITS)
        batches = max(1, -(-(shape.occurrences >> prefix) // SLICE_ENTRIES))

        filters = stored(filters.groupBy("slice", F.pmod("source", F.lit(batches)).alias("batch"))
                         .applyInArrow(_recut(half, prefix, finer, batches), FILTER), "collocations-filters")
        prefix = finer
    permutation, mask = Permutation(half), np.uint64((1 << shape.id_bits) - 1)
    places = [np.uint64(shape.id_bits * i) for i in reversed(range(shape.in_half))]

    def frequent(table: pa.Table) -> pa.Table:
        left, right, count = added(*_decoded(table, half, prefix))
        often = count >= least
        left, right = permutation.undo(left[often], right[often])
        ids = np.stack([x >> at & mask for x in (left, right) for at in places], axis=1).astype(np.int64)
        used = ids > 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used.sum(1))]), pa.int32()), pa.array(ids[used]))
        return pa.table({"ids": lists, "a": pa.array(count[often], pa.int64())})

    return filters.groupBy("slice").applyInArrow(frequent, "ids array<long>, a long")


# ---- n-grams of a stream --------------------------------------------------------------------


def _pairs(ids: np.ndarray, id_bits: int):
    """The packed pair that begins at each place, and whether there is one."""
    return ids[:-1] << np.uint64(id_bits) | ids[1:], (ids[:-1] > 0) & (ids[1:] > 0)


def pair_grams(id_bits: int):
    def grams(ids: np.ndarray):
        pair, there = _pairs(ids, id_bits)
        value, count = np.unique(pair[there], return_counts=True)
        return value >> np.uint64(id_bits), value & np.uint64((1 << id_bits) - 1), count

    return grams


def bit_of(pair: np.ndarray, bits: int) -> np.ndarray:
    """The place of a packed pair in a bitmap of 2**bits bits."""
    return mix(pair + _KEYS[0]) >> np.uint64(64 - bits)


def longer_grams(id_bits: int, bitmap: np.ndarray):
    """Phrases of three and four words all of whose pairs are in the bitmap."""

    def grams(ids: np.ndarray):
        pair, there = _pairs(ids, id_bits)
        at = np.flatnonzero(there)
        bit = bit_of(pair[at], (8 * len(bitmap)).bit_length() - 1)
        hit = np.zeros(len(pair), dtype=bool)
        hit[at] = bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
        three = np.flatnonzero(hit[:-1] & hit[1:])
        four = three[:-1][np.diff(three) == 1] if len(three) else three
        left = np.concatenate([pair[three], pair[four]])
        right = np.concatenate([ids[three + 2] << np.uint64(id_bits), pair[four + 2]])
        return added(left, right, np.ones(len(left), dtype=np.int64))

    return grams


def pair_bitmap(pairs: DataFrame, id_bits: int) -> np.ndarray:
    """The bitmap of ``pairs`` (ids): as many bytes for any number of them."""

    def bits(batches):
        for batch in batches:
            two = batch.column(0).flatten().to_numpy().reshape(-1, 2).astype(np.uint64)
            bit = bit_of(two[:, 0] << np.uint64(id_bits) | two[:, 1], size)
            yield pa.record_batch([pa.array(bit.astype(np.int64) + 1)], names=["bit"])

    size = BITMAP
    rows = pairs.select("ids").mapInArrow(bits, "bit long")
    parts = rows.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("part"))
    out = np.zeros(1 << (size - 3), dtype=np.uint8)
    for bucket, part in parts.collect():  # 4 KB each, 8 MB in all at most
        out[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(bytes(part), dtype=np.uint8)
    return out


# ---- scores -----------------------------------------------------------------------------------


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def scored(grams: DataFrame) -> DataFrame:
    """(ids, a, l, r, score) of the phrases of two words or more among ``grams`` (ids, a), by their lowest-scoring cut."""
    cuts = grams.filter(F.size("ids") > 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", 1, F.col("k")).alias("first"),
                       F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("rest"))
    parts = small_side(grams, "ids")
    cuts = (cuts.join(parts.select(F.col("ids").alias("first"), F.col("a").alias("l")), "first")
            .join(parts.select(F.col("ids").alias("rest"), F.col("a").alias("r")), "rest"))
    cuts = cuts.withColumn("score", F.expr(
        "(cast(a AS decimal(38,0)) * 2000000) div (cast(l AS decimal(38,0)) + cast(r AS decimal(38,0)))"))
    least = cuts.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("ids", "a", "cut.l", "cut.r", "cut.score")


def not_inside(phrases: DataFrame, grams: DataFrame, inside: int = INSIDE) -> DataFrame:
    """The ``phrases`` (ids, a) that no longer phrase of ``grams`` with ``inside`` percent of their occurrences holds."""
    spans = F.expr("flatten(transform(sequence(2, size(ids) - 1), n -> "
                   "transform(sequence(1, size(ids) - n + 1), s -> slice(ids, s, n))))")
    held = grams.filter(F.size("ids") > 2).select(F.explode(spans).alias("ids"), F.col("a").alias("longer"))
    held = stored(held.groupBy("ids").agg(F.max("longer").alias("longer")), "collocations-held")
    rows = phrases.join(small_side(held, "ids"), "ids", "left")
    goes = F.col("longer").isNotNull() & (_whole(F.col("longer")) * 100 >= _whole(F.col("a")) * inside)
    return rows.filter(~goes).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language of ``docs`` (lang, text)."""
    blocks = stored(blocks_of(docs), "collocations-blocks")
    entries = blocks.select("block", F.posexplode("words").alias("at", "w")).select(
        "block", (F.col("at") + 1).alias("local"), "w.lang", "w.word", "w.seen")
    often = stored(entries.groupBy("lang", "word").agg(F.sum("seen").alias("a")).filter(F.col("a") >= least),
                   "collocations-often")
    words = stored(number_rows(often, ["lang", "word"], "id"), "collocations-words")
    totals = stored(entries.groupBy("lang").agg(F.sum("seen").alias("n")), "collocations-totals")
    largest, occurrences = words.agg(F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    two, four = (Shape(largest, occurrences, n) for n in (1, 2))
    coded = coded_blocks(blocks, entries, words)

    pairs = stored(merged(block_filters(coded, two, pair_grams(two.id_bits)), two, least), "collocations-pairs")
    shared, id_bits = docs.sparkSession.sparkContext.broadcast(pair_bitmap(pairs, two.id_bits)), two.id_bits
    longer = merged(block_filters(coded, four, lambda ids: longer_grams(id_bits, shared.value)(ids)), four, least)
    grams = stored(words.select(F.array("id").alias("ids"), "a").unionByName(pairs).unionByName(longer), "collocations-grams")

    phrases = stored(not_inside(scored(grams), grams), "collocations-scored")
    named = small_side(words.select("lang", "word", "id"))
    phrases = phrases.join(named.select(F.col("id").alias("head"), "lang"), F.col("ids")[0] == F.col("head")).drop("head")
    by_rank = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = stored(phrases.withColumn("place", F.rank().over(by_rank)).filter(F.col("place") <= top).drop("place"),
                  "collocations-near")
    spelt = (near.select("ids", F.posexplode("ids").alias("at", "id")).join(named.select("id", "word"), "id")
             .groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("said"))
             .select("ids", F.array_join(F.col("said.word"), " ").alias("phrase")))
    rows = near.join(spelt, "ids").join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
