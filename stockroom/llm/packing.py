"""Packing of documents into token sequences: concatenate and cut.

All documents' tokens form one long row, in the order of the written token
table (its parts in order, then the rows of a part). Pass one writes the tokens
with each document's start inside its part and sums the tokens of every part;
the running sum of those totals gives every part its global offset. Pass two
adds the two and cuts at every multiple of the window length. A document that
crosses a cut gives one boundary record per window it touches. Only part
totals, one small row per part, meet in one place.

Sequences are full windows but for the last, so padding is under one window in
all. A sequence is padded to the window length, unless its length is a power of
two, which stays as it is (``padded_tokens``).

Results for special rows: a null text is empty, so its document has the closing
id alone; a null or repeated ``doc_id`` is passed through, each row as a
document of its own; an empty table gives no pieces.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_side, stored, text_or_empty
from .token_memo import TokenMemo
from .wordhash import chunks

WINDOW = 4096
END_ID = 2
# Words given to the library as one text.
WORDS_AT_ONCE = 2_000



@functools.lru_cache(maxsize=2)
def load(path: str) -> TokenMemo:
    """The tokenizers library's ids of ``path``; a word is given to it once while remembered."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    if [x for x, _ in library.pre_tokenizer.pre_tokenize_str("a b")] != ["a", "b"]:
        raise ValueError(f"{path}: its pieces hold white space")

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, ids = [], []
        for lo in range(0, len(words), WORDS_AT_ONCE):
            some = words[lo:lo + WORDS_AT_ONCE]
            said = library.encode(" ".join(some), add_special_tokens=False)
            past = np.cumsum([len(x) + 1 for x in some])  # a word's tokens begin before its end in the text
            at = np.array(said.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            sizes.append(np.diff(np.searchsorted(at, np.concatenate([[0], past]))))
            ids.append(np.array(said.ids, dtype=np.int32))
        return np.concatenate(sizes), np.concatenate(ids)

    return TokenMemo(encode)


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Pass one: (doc_id, part, start_in_part, doc_tokens, ids as little-endian 32-bit binary)."""

    def run(batches):
        memo = load(tokenizer_path)
        at = 0
        for batch in batches:
            for lo, group in chunks(batch.column(2)):
                counts, ids = memo.ids(group)
                counts = counts + 1
                ends = np.cumsum(counts)
                flat = np.full(int(ends[-1]), end_id, dtype="<u4")
                closing = np.zeros(len(flat), dtype=bool)
                closing[ends - 1] = True
                flat[~closing] = ids
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.record_batch(
                    [batch.column(0).slice(lo, len(counts)), batch.column(1).slice(lo, len(counts)),
                     pa.array(at + ends - counts, pa.int64()), pa.array(counts, pa.int64()), raw],
                    names=["doc_id", "part", "start_in_part", "doc_tokens", "ids"])
                at += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().cast("long").alias("part"),
                       text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, part long, start_in_part long, doc_tokens long, ids binary")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Pass two: each document's ``global_start``, from the running sum of the part totals."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("part_tokens"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("part_tokens").over(order), F.lit(0)).alias("base"),
                          F.sum("part_tokens").over(Window.partitionBy()).alias("all_tokens"))
    return (tokens.join(small_side(stored(bases, "packing-bases")), "part")
            .withColumn("global_start", F.col("base") + F.col("start_in_part")).drop("base", "start_in_part", "part"))


def cut(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """One boundary record per document and window: where the piece lies in both, and its ids' checksum."""
    first = F.floor(F.col("global_start") / window)
    last = F.floor((F.col("global_start") + F.col("doc_tokens") - 1) / window)
    pieces = documents.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("global_start"), F.col("sequence_id") * window)
    end = F.least(F.col("global_start") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * window)
    size = F.least(F.lit(window).cast("long"), F.col("all_tokens") - F.col("sequence_id") * window)
    pieces = pieces.withColumn("begin", begin).withColumn("length", end - begin).withColumn("sequence_tokens", size)
    start = F.col("begin") - F.col("global_start")
    raw = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return pieces.select(
        "doc_id", start.alias("start"), "length", F.crc32(raw).alias("ids_crc32"), "doc_tokens", "sequence_id",
        (F.col("begin") - F.col("sequence_id") * window).alias("offset"),
        "sequence_tokens",
        F.when(F.expr("sequence_tokens & (sequence_tokens - 1)") == 0, F.col("sequence_tokens"))
        .otherwise(F.lit(window).cast("long")).alias("padded_tokens"),
        raw.alias("ids"))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """All pieces of ``docs`` (doc_id, text), with their ids (little-endian unsigned 32-bit)."""
    tokens = stored(tokenise(docs, tokenizer_path, end_id), "packing-tokens")
    return cut(with_offsets(tokens), window)
