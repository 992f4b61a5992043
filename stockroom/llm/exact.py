"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after each run of white space is one space.
A first pass keeps (doc_id, length, prefix hash) of every row, a few bytes each.
Rows alone in their length leave; of the others, rows alone in their (length,
prefix hash) leave; only the surviving groups' texts are read in full and
grouped by a SHA-256. Shuffles carry keys, never texts, and are pre-aggregated,
so one text may hold any share of the rows.

Results for special rows: a null text is empty; a null ``doc_id`` counts as
larger than all others, and stays only if its group has no other; rows that
repeat a ``doc_id`` with an equal text are each returned, and one of them is
kept; rows with one ``doc_id`` and different texts are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_RUN, small_side, stored, text_or_empty

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, " ")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_or_empty()).alias("body"))


def exact_dedup(docs: DataFrame, hash_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs`` (doc_id, text).

    ``keep_id`` is the row of the group that stays. ``text_sha256`` is null for
    rows whose text the refinement had no need to read in full, unless
    ``hash_all`` asks for every row's digest as an output of its own.
    """
    profile = stored(
        _rows(docs).select("doc_id", F.length("body").alias("length"),
                           F.xxhash64(F.substring("body", 1, prefix_chars)).alias("prefix_hash")), "exact-profile")
    by_length = stored(profile.groupBy("length").count().filter("count > 1").drop("count"), "exact-lengths")
    by_prefix = (profile.join(small_side(by_length), "length", "left_semi").groupBy("length", "prefix_hash").count()
                 .filter("count > 1").select("length", "prefix_hash", F.lit(True).alias("candidate")))
    groups = small_side(stored(by_prefix, "exact-groups"))

    rows = _rows(docs).select("doc_id", "body", F.length("body").alias("length"),
                              F.xxhash64(F.substring("body", 1, prefix_chars)).alias("prefix_hash"))
    digest = F.sha2("body", 256)
    if hash_all:  # the digest goes along instead of the text
        rows = rows.select("doc_id", "length", "prefix_hash", digest.alias("text_sha256"))
        read = rows.join(groups, ["length", "prefix_hash"], "left")
    else:
        read = rows.join(groups, ["length", "prefix_hash"], "left").withColumn(
            "text_sha256", F.when(F.col("candidate"), digest)).drop("body")
    read = stored(read.select("doc_id", F.coalesce("candidate", F.lit(False)).alias("candidate"), "text_sha256"),
                  "exact-hashes")

    copies = read.filter("candidate").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    whole = copies.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
    whole = stored(whole, "exact-whole")  # written, so that the join below can split a large group
    decided = (copies.join(small_side(whole), "text_sha256")
               .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
               .select("doc_id", "keep_id", "group_size",
                       (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                       "text_sha256"))
    alone = read.filter("NOT candidate").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return decided.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`exact_dedup` keeps."""
    marks = stored(
        exact_dedup(docs).filter("group_size > 1").groupBy("doc_id", "text_sha256")
        .agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n_rows"))
        .filter("NOT stays OR n_rows > 1").withColumnsRenamed({"doc_id": "mark_id", "text_sha256": "mark_sha"}),
        "exact-marks")
    rows = docs.withColumn("row_sha__", F.sha2(normalised(text_or_empty()), 256))
    same = (rows["row_sha__"] == marks["mark_sha"]) & rows["doc_id"].eqNullSafe(marks["mark_id"])
    kept = rows.join(small_side(marks.filter("NOT stays")), same, "left_anti")
    repeats = marks.filter("stays")
    if not repeats.isEmpty():  # rows that repeat a kept document
        repeats = small_side(repeats)
        once = kept.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "row_sha__"])
        kept = kept.join(repeats, same, "left_anti").unionByName(once)
    return kept.drop("row_sha__")
