"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_dir

# The word rule of every operator here: runs of characters other than these six.
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

# A side is broadcast only when its counted rows (of a few short columns) and the
# elements of its arrays stay under these; beyond, the same join is a shuffle join.
BROADCAST_ROWS = 200_000
BROADCAST_ELEMENTS = 2_000_000


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor re-reads files instead of replaying the
    steps before. The folder is the one ``spark.checkpoint.dir`` names.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, *arrays: str) -> DataFrame:
    """A stored side of a join, hinted for broadcast only if its counted rows and array elements allow it."""
    elements = sum((F.coalesce(F.size(a), F.lit(0)) for a in arrays), F.lit(0))
    rows, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(elements), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_ELEMENTS else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a non-null text, as an array (empty for a text without words)."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))
