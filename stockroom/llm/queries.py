"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe, chat, collocations, exact, html_extract, minhash, packing, quality, secrets, substring, token_counts, warc, whitening)

QueryFn = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document by segment-tree BPE, decode the ids, digest both."""
    path = word_vocabulary()
    rows = bpe.round_trip(_table(spark, sf_dir, "documents"), path)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expand all conversations, and one whose texts hold control strings, into examples; digest what reads back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.posexplode(
        F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = chat.conversations(chat.prefix_target_examples(turns.unionByName(tricky)))
    rows = rows.withColumn("turns", chat.read_turns())
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("masked", "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the quality cascade for every document."""
    rows = quality.judge(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC archives, read those back and merge their indexes.

    The table has no capture times; the stand-in is one second per page id, over again after 10**9 of them.
    """
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", "url", "html", F.timestamp_seconds(F.pmod("page_id", F.lit(10**9)) + 1_700_000_000).alias("captured"))
    rows = warc.capture_history(pages)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens, cut freely."""
    return packing.pack(_table(spark, sf_dir, "documents"), word_vocabulary()).drop("ids")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove from all documents the words of 20-word windows that start earlier elsewhere."""
    rows = substring.remove_repeated(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents."""
    return minhash.near_dedup(_table(spark, sf_dir, "documents")).drop("t")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    rows = html_extract.main_text(_table(spark, sf_dir, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document, with each one's digest."""
    return exact.exact_dedup(_table(spark, sf_dir, "documents"), hash_all=True)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    rows = secrets.report(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two to four words in each language of all documents."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it passes the limit of 2048 tokens."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), word_vocabulary())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every usable embedding."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, QueryFn]:
    return {f.__name__: f for f in (
        op1_bpe, op2_chat, op3_quality, op4_warc, op5_packing, op6_substring_dedup, op7_minhash_dedup, op8_html_extract,
        op9_exact_dedup, op10_secrets, op11_collocations, op12_token_counts, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    from .oracle import ORACLE
    return dict(ORACLE)
