"""Batch results written over the stored tables, partition by partition.

The stored tables are partitioned by store, orders and their lines also by the
year of the order. A batch touches few of these partitions, and only they are
written again:

1. the new content of every touched partition is written to the folder of the
   batch, ``{root}/_batches/{batch_id}/{table}``, then the mark ``_ready``;
2. the live tables take it over by dynamic partition overwrite, touched partitions
   that hold no row any more are removed, and the mark ``_done`` is written.

A run that ends before ``_ready`` has changed nothing and starts anew. One that ends
later finds the content in the folder, whatever state the live partitions are in,
and only repeats step 2, which gives the same again. A batch that is done is left
alone. So a batch takes effect once, however often it is run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SCHEMAS, TOTALS
from .tables import Tables

# Partition columns of the stored tables, with their types.
STORE, YEAR = T.StructField("store_id", T.LongType()), T.StructField("year", T.IntegerType())
PARTITIONS: dict[str, list[T.StructField]] = {
    "products": [STORE], "sales": [STORE, YEAR], "purchases": [STORE, YEAR],
    "sale_items": [STORE, YEAR], "purchase_items": [STORE, YEAR],
    "sale_totals": [STORE], "purchase_totals": [STORE],
}
HEADERS = {"sale_items": ("sales", "sale_id"), "purchase_items": ("purchases", "purchase_id")}
# So many values of a partition column are given to the scan as a list.
LISTED = 1_000


@dataclass
class Change:
    """Rows of a table that are new or take the place of the row with their id, and ids of rows that go."""

    upserts: DataFrame
    removed: DataFrame | None = None


def _schema(name: str) -> T.StructType:
    return TOTALS if name.endswith("_totals") else SCHEMAS[name]


def _columns(name: str) -> list[str]:
    """The table's own columns, then the partition columns that aren't among them."""
    own = _schema(name).names
    return own + [f.name for f in PARTITIONS[name] if f.name not in own]


def _placed(name: str, rows: DataFrame, headers: DataFrame | None) -> DataFrame:
    """``rows`` with the table's partition columns; lines get those of their order (none: NULL)."""
    if name in HEADERS:
        key = HEADERS[name][1]
        rows = rows.join(headers.select(F.col("id").alias(key), "store_id", F.year("created_at").alias("year")), key, "left")
    elif YEAR in PARTITIONS[name]:
        rows = rows.withColumn("year", F.year("created_at"))
    return rows.select(*_columns(name))


def _write(rows: DataFrame, name: str, path: str, dynamic: bool) -> None:
    parts = [f.name for f in PARTITIONS[name]]
    writer = rows.hint("rebalance", *parts).write.mode("overwrite").partitionBy(*parts)
    writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(path)


def write_stored(t: Tables, root: str, names: list[str]) -> None:
    """The first version of the stored tables ``names``."""
    for name in names:
        headers = t[HEADERS[name][0]] if name in HEADERS else None
        _write(_placed(name, t[name], headers), name, f"{root}/{name}", dynamic=False)


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    own = _schema(name)
    schema = T.StructType([*own.fields, *(f for f in PARTITIONS[name] if f.name not in own.names)])
    return spark.read.schema(schema).parquet(path).select(*_columns(name))


def read_stored(spark: SparkSession, root: str, names: list[str]) -> Tables:
    """The stored tables as they are now, with their own columns."""
    def reader(name):
        return lambda t: _read(spark, f"{root}/{name}", name).select(*_schema(name).names)

    return Tables(spark, {n: reader(n) for n in names})


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder)


def mark(spark: SparkSession, path: str) -> None:
    fs, file = _folder(spark, path)
    fs.create(file, True).close()


def _stage(spark: SparkSession, root: str, folder: str, name: str, change: Change, headers: DataFrame | None) -> None:
    """The new content of the partitions that ``change`` touches, and the list of them."""
    parts = [f.name for f in PARTITIONS[name]]
    live = _read(spark, f"{root}/{name}", name)
    # written once: the steps below read the change several times
    new, ids = f"{folder}/_new/{name}", f"{folder}/_ids/{name}"
    placed = _placed(name, change.upserts, headers)
    placed.write.mode("overwrite").parquet(new)
    new = spark.read.schema(placed.schema).parquet(new)
    named = new.select("id")
    if change.removed is not None:
        named = named.unionByName(change.removed.select("id"))
    named.distinct().write.mode("overwrite").parquet(ids)
    ids = spark.read.schema(named.schema).parquet(ids)
    # a row that changes may lie in another partition than its new version
    touched = new.select(*parts).unionByName(live.join(ids, "id", "left_semi").select(*parts)).distinct()
    touched.write.mode("overwrite").parquet(f"{folder}/_touched/{name}")
    touched = spark.read.schema(T.StructType(PARTITIONS[name])).parquet(f"{folder}/_touched/{name}")
    for part in parts:
        values = [r[0] for r in touched.select(part).distinct().limit(LISTED + 1).collect()]
        if len(values) <= LISTED:  # the scan reads no other folders
            listed = F.col(part).isin([v for v in values if v is not None])
            live = live.filter(listed | F.col(part).isNull() if None in values else listed)
    same = [live[p].eqNullSafe(touched[p]) for p in parts]
    kept = live.join(touched, same, "left_semi").join(ids, "id", "left_anti")
    _write(kept.select(*_columns(name)).unionByName(new), name, f"{folder}/{name}", dynamic=False)


def _take_over(spark: SparkSession, root: str, folder: str, name: str) -> None:
    parts = [f.name for f in PARTITIONS[name]]
    new = _read(spark, f"{folder}/{name}", name)
    _write(new, name, f"{root}/{name}", dynamic=True)
    touched = spark.read.schema(T.StructType(PARTITIONS[name])).parquet(f"{folder}/_touched/{name}")
    filled = new.select(*parts).distinct()
    empty = touched.join(filled, [touched[p].eqNullSafe(filled[p]) for p in parts], "left_anti")
    for row in empty.toLocalIterator():  # folders, not rows
        path = "/".join(f"{p}={'__HIVE_DEFAULT_PARTITION__' if row[p] is None else row[p]}" for p in parts)
        fs, at = _folder(spark, f"{root}/{name}/{path}")
        fs.delete(at, True)


def apply_batch(spark: SparkSession, root: str, batch_id: str, names: list[str],
                make: Callable[[Tables], dict[str, Change]]) -> bool:
    """Write the results of one batch over the stored tables ``names``; False where that was done before.

    ``make`` gets the stored tables and gives the changes of each that has any. Batches are run one after another.
    """
    folder = f"{root}/_batches/{batch_id}"
    if exists(spark, f"{folder}/_done"):
        return False
    if not exists(spark, f"{folder}/_ready"):
        t = read_stored(spark, root, names)
        changes = make(t)
        for name, change in changes.items():
            headers = None
            if name in HEADERS:
                of = HEADERS[name][0]
                new = changes[of].upserts.select("id", "store_id", "created_at") if of in changes else None
                headers = t[of].select("id", "store_id", "created_at")
                if new is not None:
                    headers = headers.join(new.select("id"), "id", "left_anti").unionByName(new)
            _stage(spark, root, folder, name, change, headers)
        mark(spark, f"{folder}/_ready")
    for name in names:
        if exists(spark, f"{folder}/{name}"):
            _take_over(spark, root, folder, name)
    mark(spark, f"{folder}/_done")
    return True
