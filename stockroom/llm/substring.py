"""Substring dedup by level-wise doubling of repeated word windows.

Level one looks at windows of half the asked length. Every window of the full
length contains several of those; the one with the least hash is its anchor, so
equal windows have equal anchors at equal places, and only anchors (about one
position in six) need to be counted. Windows whose anchor is repeated, and only
they, are extended to twice that length, the asked one, by level two. What
survives it is a window that occurs twice; all but its first occurrence (least
doc_id, then earliest start) is removed, and a word goes when any removed window
covers it. The doubling ends there: a longer repeated window is made of repeated
windows of the asked length, so further levels would remove no more words.

Documents equal in all their words are settled first, by a SHA-256 of the whole
word sequence: all but the first lose every window, so the windows of a large
group of copies are never shuffled. Window hashes are 64-bit while they only
choose candidates, 96-bit where they decide, over 64-bit hashes of the words.

Results for special rows: a null text has no words; a null ``doc_id`` counts as
larger than all others; rows that share a ``doc_id`` remove nothing from each
other, each loses what starts earlier in itself or under a smaller ``doc_id``.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_side, stored, text_or_empty
from .wordhash import Hasher, chunks, cut_words, sequence_keys

WINDOW = 20
LAST_ID = (1 << 63) - 1


@functools.lru_cache(maxsize=None)
def _hasher(seed: int) -> Hasher:
    return Hasher(seed)


def _anchors(word: np.ndarray, doc: np.ndarray, length: int):
    """Starts of the full windows, and for each the position and hash of its anchor."""
    half = length // 2
    n = len(word)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    place = np.arange(n - half + 1)
    small = _hasher(1).windows(word, place, place + half)
    starts = np.flatnonzero(doc[:n - length + 1] == doc[length - 1:])
    least, at = small[starts], np.zeros(len(starts), dtype=np.int64)
    for k in range(1, length - half + 1):
        other = small[starts + k]
        lower = other < least
        least = np.where(lower, other, least)
        at[lower] = k
    return starts, starts + at, least


def _per_doc(doc_of: np.ndarray, n_docs: int) -> np.ndarray:
    return np.searchsorted(doc_of, np.arange(n_docs + 1))


def _list(values: np.ndarray, doc_of: np.ndarray, n_docs: int, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_per_doc(doc_of, n_docs).astype(np.int32)), pa.array(values, kind))


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"),
                       F.xxhash64(text).alias("t"), text.alias("text"))


def _profile(docs: DataFrame, length: int) -> DataFrame:
    """Per row: its word count, a hash of its word sequence, and the hashes of its anchors in order."""

    def run(batches):
        for batch in batches:
            for lo, texts in chunks(batch.column(2)):
                n = len(texts)
                data, doc, first, end = cut_words(texts)
                word = _hasher(0).words(data, first, end)
                bounds = _per_doc(doc, n)
                seq = sequence_keys(texts)
                _, at, least = _anchors(word, doc, length)
                new = np.ones(len(at), dtype=bool)
                new[1:] = at[1:] != at[:-1]
                yield pa.record_batch(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(np.diff(bounds), pa.int64()),
                     pa.array(seq[0]), pa.array(seq[1]), _list(least[new].view(np.int64), doc[at[new]], n, pa.int64())],
                    names=["d", "t", "n_words", "seq_a", "seq_b", "anchors"])

    return _keyed(docs).mapInArrow(
        run, "d long, t long, n_words long, seq_a long, seq_b long, anchors array<long>")


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """Of ``docs`` (d, variant, text, runs of anchor numbers), every full window under those anchors, with its hash."""

    def run(batches):
        for batch in batches:
            for lo, texts in chunks(batch.column(2)):
                n = len(texts)
                data, doc, first, end = cut_words(texts)
                word = _hasher(0).words(data, first, end)
                starts, at, _ = _anchors(word, doc, length)
                new = np.ones(len(at), dtype=bool)
                new[1:] = at[1:] != at[:-1]
                number = np.cumsum(new) - 1  # of the window's anchor, over all these documents
                anchor_base = _per_doc(doc[at[new]], n)
                kept = np.zeros(int(anchor_base[-1]) + 1, dtype=np.int64)
                for i, runs in enumerate(batch.column(3).slice(lo, n).to_pylist()):
                    for r in runs:
                        kept[anchor_base[i] + r["first"]] += 1
                        kept[anchor_base[i] + r["last"] + 1] -= 1
                take = np.cumsum(kept)[number] > 0 if len(number) else np.zeros(0, bool)
                starts = starts[take]
                if not len(starts):
                    continue
                key = _hasher(2).windows(word, starts, starts + length)
                check = _hasher(3).windows(word, starts, starts + length) >> np.uint64(32)
                owner = doc[starts]
                order = np.lexsort((starts, check, key, owner))
                again = np.zeros(len(starts), dtype=bool)  # the same window earlier in the same document
                a, b = order[1:], order[:-1]
                again[a] = (owner[a] == owner[b]) & (key[a] == key[b]) & (check[a] == check[b])
                base = _per_doc(doc, n)[:-1]
                index = pa.array(owner)
                for s in range(0, len(starts), 50_000):
                    e = s + 50_000
                    yield pa.record_batch(
                        [batch.column(0).slice(lo, n).take(index[s:e]), batch.column(1).slice(lo, n).take(index[s:e]),
                         pa.array((starts - base[owner])[s:e], pa.int32()), pa.array(key[s:e].view(np.int64)),
                         pa.array(check[s:e].astype(np.uint32).view(np.int32)), pa.array(again[s:e])],
                        names=["d", "variant", "start", "key", "check", "again"])

    return docs.mapInArrow(run, "d long, variant int, start int, key long, check int, again boolean")


def _cover(length: int) -> str:
    """SQL: sorted starts of removed windows to the word intervals they cover."""
    return (f"aggregate(sort_array(collect_set(start)), cast(array() AS array<struct<first:int,past:int>>), (a, s) -> "
            f"CASE WHEN size(a) > 0 AND element_at(a, -1).past >= s THEN concat(slice(a, 1, size(a) - 1), "
            f"array(named_struct('first', element_at(a, -1).first, 'past', s + {length}))) "
            f"ELSE array_append(a, named_struct('first', s, 'past', s + {length})) END)")


def repeated_words(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """(d, t, covered) of the rows that lose words; ``covered``: word intervals, null for all words."""
    profile = stored(_profile(docs, length), "substring-profile")
    long = profile.filter(F.col("n_words") >= length)

    groups = long.groupBy("seq_a", "seq_b").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    groups = stored(groups.filter("last_d > first_d"), "substring-copy-groups")
    copies = stored(long.select("d", "t", "n_words", "seq_a", "seq_b").join(small_side(groups), ["seq_a", "seq_b"])
                    .filter("d > first_d").select("d", "t", "n_words").distinct(), "substring-copies")
    firsts = long.join(small_side(copies.select("d", "t")), ["d", "t"], "left_anti")

    # level one: anchors that occur twice, in one text or in several
    anchors = firsts.select("d", "t", F.posexplode("anchors").alias("number", "anchor"))
    twice = firsts.select(F.explode("anchors").alias("anchor")).groupBy("anchor").count().filter("count > 1").drop("count")
    twice = stored(twice, "substring-anchors")  # written, so that the join below can split a frequent anchor
    found = anchors.join(twice, "anchor").groupBy("d", "t").agg(F.sort_array(F.collect_set("number")).alias("numbers"))
    runs = F.expr(
        "aggregate(numbers, cast(array() AS array<struct<first:int,last:int>>), (a, x) -> "
        "CASE WHEN size(a) > 0 AND element_at(a, -1).last = x - 1 THEN concat(slice(a, 1, size(a) - 1), "
        "array(named_struct('first', element_at(a, -1).first, 'last', x))) "
        "ELSE array_append(a, named_struct('first', x, 'last', x)) END)")
    variant = F.row_number().over(Window.partitionBy("d").orderBy("t")).cast("int")
    candidates = stored(found.select("d", "t", runs.alias("runs"), variant.alias("variant")), "substring-candidates")

    # level two: the full windows under those anchors
    texts = _keyed(docs).join(small_side(candidates, "runs"), ["d", "t"]).select("d", "variant", "text", "runs")
    windows = _windows(texts, length)
    first = windows.filter("NOT again").groupBy("key", "check").agg(
        F.min("d").alias("first_d"), F.max("d").alias("last_d")).filter("last_d > first_d").drop("last_d")
    first = stored(first, "substring-first")
    gone = windows.join(first, ["key", "check"], "left").filter("again OR d > first_d")
    covered = gone.groupBy("d", "variant").agg(F.expr(_cover(length)).alias("covered"))
    covered = stored(covered, "substring-covered")
    lost = (candidates.select("d", "t", "variant").join(covered, ["d", "variant"])
            .select("d", "t", "covered"))
    return copies.select("d", "t", F.lit(None).cast("array<struct<first:int,past:int>>").alias("covered")).unionByName(lost)


def remove_repeated(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per row of ``docs`` (doc_id, text); kept words joined by one space."""
    lost = stored(repeated_words(docs, length).withColumn("lost", F.lit(True)), "substring-lost")

    def run(batches):
        for batch in batches:
            for lo, texts in chunks(batch.column(1)):
                n = len(texts)
                lists = batch.column(3).slice(lo, n).to_pylist()
                some = batch.column(2).slice(lo, n).to_pylist()
                total, removed, kept = [], [], []
                for text, cover, lose in zip(texts.cast(pa.binary()).to_pylist(), lists, some):
                    words = text.split()  # bytes: exactly the six separators
                    total.append(len(words))
                    if lose and cover is None:
                        words = []
                    elif lose:
                        for r in reversed(cover):
                            del words[r["first"]:r["past"]]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.record_batch(
                    [batch.column(0).slice(lo, n), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    rows = _keyed(docs).withColumn("doc_id", F.nullif("d", F.lit(LAST_ID)))
    rows = rows.join(small_side(lost, "covered"), ["d", "t"], "left").select("doc_id", "text", "lost", "covered")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
