"""Exclusive running sums ("sum of everything before me") that split hot keys.

A plain ``sum().over(partitionBy(key).orderBy(ts).rowsBetween(-inf, -1))``
puts every row of one key into one task. Here the rows are dealt into buckets,
runs of the (key, ts, tie) order of about equal size that cut a key at any
row (:func:`bucketed`); bucket totals are partially aggregated (a hot key is
combined map-side), bucket offsets are a running sum over one row per bucket,
and the in-bucket running sum only sees one bucket of one key. The result is
identical to the single window, however many rows of a key share a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

BUCKET = "_bucket"


def bucketed(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_bucket``: its place among the runs of a range partitioning by ``order``.

    Checkpointed, so that every later use sees the same buckets. Buckets
    follow one another in ``order``.
    """
    d = df.repartitionByRange(*order).withColumn(BUCKET, F.spark_partition_id())
    return cut(d)


def sum_before(df: DataFrame, key: str, ts: str, tie: list[str], cols: list[str]) -> DataFrame:
    """Add ``{c}_before`` = Σ ``c`` over rows of the same ``key`` strictly earlier
    in (``ts``, ``*tie``) order, for each ``c`` in ``cols``; rows carry ``_bucket``."""
    b = BUCKET
    # Shuffle by (key, bucket) first. An input already hash-partitioned by
    # ``key`` would satisfy every step below, so Spark would add no exchange and
    # a hot key would be read and sorted in one task. After this shuffle the
    # bucket totals and the in-bucket window need no exchange, and only the
    # small per-bucket rows move again (by key for the offsets, then back).
    d = df.repartition(key, b)
    tot = d.groupBy(key, b).agg(*[F.sum(c).alias(c) for c in cols])
    w1 = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(key, b, *[F.coalesce(F.sum(c).over(w1), F.lit(0)).alias(f"_{c}_base") for c in cols])
    order: list[Column] = [F.col(ts).asc_nulls_first()] + [F.col(x) for x in tie]
    w2 = Window.partitionBy(key, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", *[F.coalesce(F.sum(c).over(w2), F.lit(0)).alias(f"_{c}_in") for c in cols])
    d = d.join(offs, [key, b], "left")
    return d.select(*df.columns, *[(F.coalesce(F.col(f"_{c}_base"), F.lit(0)) + F.col(f"_{c}_in")).alias(f"{c}_before")
                                   for c in cols])
