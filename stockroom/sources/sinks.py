"""Sinks: the ledger append and JSON export.

Writes are the only place data leaves Spark; every sink is a distributed
write (one file per task), never a driver collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SCHEMAS


def append_ledger(ledger: DataFrame, path: str) -> None:
    """Append ledger rows to the ``inventory_transactions`` table, partitioned by store.

    Partitioning by store lets per-store listings prune whole folders; rows of
    a store are brought together before (a large store in several tasks). A
    micro-batch of a stream is appended by :func:`append_ledger_batch`.
    """
    cols = [f.name for f in SCHEMAS["inventory_transactions"].fields]
    extra = [c for c in ledger.columns if c not in cols]
    ledger.select(*cols, *extra).hint("rebalance", "store_id").write.mode("append").partitionBy("store_id").parquet(path)


def append_ledger_batch(ledger: DataFrame, path: str, batch_id: int) -> None:
    """Append the ledger rows of one micro-batch, exactly once.

    The table is partitioned by store, then by batch. A batch that is delivered again overwrites its own
    partitions (dynamic overwrite touches no others), so no row is doubled and no earlier batch is read.
    """
    (ledger.withColumn("batch", F.lit(batch_id).cast("bigint")).hint("rebalance", "store_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store_id", "batch").parquet(path))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The appended ledger with its declared types (the partition column stays bigint), by whatever sink it was written."""
    from pyspark.sql import types as T
    base = SCHEMAS["inventory_transactions"]
    schema = T.StructType([f for f in base.fields] + [T.StructField("change_id", T.LongType())])
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def to_json_documents(df: DataFrame) -> DataFrame:
    """One JSON text per row, NULL fields kept (the source answers with them)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def export_json(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines (nested arrays stay nested), NULL fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
