"""Change records: the row-trigger input, as a batch frame or a stream.

A change record is ``(change_id, table, op, before, after, store_id,
user_id, ts)``: ``op`` is 'I', 'U' or 'D'; ``before``/``after`` are the OLD
and NEW row images (NULL where the operation has none). The header's store
and acting user travel with the record, so ledger rows never depend on the
header still being present (a deleted header is not looked up).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import MONEY, TS

LINE_IMAGE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("order_id", T.LongType()),
    T.StructField("product_id", T.LongType()), T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", MONEY)])

LINE_CHANGE = T.StructType([
    T.StructField("change_id", T.LongType()), T.StructField("table", T.StringType()),
    T.StructField("op", T.StringType()), T.StructField("before", LINE_IMAGE),
    T.StructField("after", LINE_IMAGE), T.StructField("store_id", T.LongType()),
    T.StructField("user_id", T.LongType()), T.StructField("ts", TS)])


def line_change_records(flat: DataFrame) -> DataFrame:
    """Nest flat before/after columns into the change-record shape."""
    def image(prefix: str):
        has = F.col("op").isin("U", "D") if prefix == "b" else F.col("op").isin("I", "U")
        return F.when(has, F.struct(F.col("line_id").alias("id"), F.col("order_id"), F.col("product_id"),
                                    F.col(f"{prefix}_quantity").cast("int").alias("quantity"),
                                    F.col(f"{prefix}_unit_price").cast(MONEY).alias("unit_price")))
    out = flat.select(F.col("change_id").cast("bigint"), F.col("tbl").alias("table"), "op",
                      image("b").alias("before"), image("a").alias("after"),
                      F.col("store_id").cast("bigint"), F.col("user_id").cast("bigint"),
                      F.col("ts").cast(TS))
    return out


def write_change_files(records: DataFrame, path: str, rows_per_file: int) -> None:
    """Write records in time order (for replays), at most ``rows_per_file`` in a file; tasks follow the data's size."""
    (records.repartitionByRange("ts", "change_id").sortWithinPartitions("ts", "change_id")
     .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path))


def read_change_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                       max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Structured Streaming source of change records (fixed schema, parquet files).

    A micro-batch takes at most so many files, or about so many bytes.
    """
    reader = spark.readStream.schema(LINE_CHANGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    return reader.parquet(path)


def run_change_stream(spark: SparkSession, path: str, out_path: str, checkpoint: str,
                      max_bytes_per_trigger: int | None = None) -> None:
    """Drain the change stream into a parquet table, as it is (append; exactly once by the sink's commit log)."""
    q = (read_change_stream(spark, path, max_bytes_per_trigger=max_bytes_per_trigger).writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
