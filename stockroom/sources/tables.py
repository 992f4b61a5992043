"""Loading the canonical tables.

Two ways in:

* :func:`load_tables` reads canonical tables (one folder each, parquet) with
  fixed schemas -- the production path. Nothing is inferred.
* :func:`from_testdata` maps the driver's test tables onto the canonical ones
  with the shared mapping text in :mod:`stockroom.sources.fixture_sql`.

Both return a :class:`Tables` bundle whose frames are lazy; a query only
scans the parquet columns it actually uses (Catalyst prunes the rest).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..functions.lineage import keep
from . import fixture_sql
from .fixture_frames import FRAMES
from .schemas import SCHEMAS, evolve_schema, stored_schema


class Tables:
    """Lazy bundle of named DataFrames (canonical tables and derived inputs)."""

    def __init__(self, spark: SparkSession, builders: dict):
        self.spark = spark
        self._builders = builders
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name not in self._builders:
                raise KeyError(name)
            self._frames[name] = self._builders[name](self)
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(name) from e

    def __contains__(self, name: str) -> bool:
        return name in self._builders

    def replace(self, **frames: DataFrame) -> "Tables":
        """A new bundle with some tables swapped (e.g. a new snapshot)."""
        builders = dict(self._builders)
        for k, df in frames.items():
            builders[k] = (lambda d: (lambda _t: d))(df)
        return Tables(self.spark, builders)

    def names(self) -> list[str]:
        return list(self._builders)

    def written(self, *names: str) -> "Tables":
        """A new bundle with ``names`` written once, one after the other, under the shared checkpoint folder.

        For tables that one job reads several times; what is mapped from them reads the written rows as well.
        """
        out = self
        for n in names:
            out = out.replace(**{n: keep(out[n], n)})
        return out


def _raw_builder(sf_dir: str, name: str):
    return lambda t: t.spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _mapped_builder(name: str):
    def build(t: Tables) -> DataFrame:
        sql = (fixture_sql.MAPPING[name].replace("{json_k}", fixture_sql.JSON_K["spark"])
               .replace("{ntz}", fixture_sql.NTZ["spark"]))
        frames = {r: t[r] for r in set(fixture_sql.references(sql))}
        df = t.spark.sql(sql, **frames)
        return evolve_schema(df, name) if name in SCHEMAS else df
    return build


def from_testdata(spark: SparkSession, sf_dir: str) -> Tables:
    """Canonical tables (and request batches) mapped from the test tables."""
    builders: dict = {r: _raw_builder(sf_dir, r) for r in fixture_sql.RAW_TABLES}
    for name in fixture_sql.MAPPING:
        builders[name] = FRAMES.get(name) or _mapped_builder(name)
    return Tables(spark, builders)


def load_tables(spark: SparkSession, root: str, tables: list[str] | None = None,
                predate: dict[str, list[str]] | None = None) -> Tables:
    """Read canonical tables written as ``{root}/{table}`` parquet folders.

    The schema is given, never inferred: no file footer is read to plan a
    query. Files may be of different ages: one that is too old to have a column
    gives its declared default (:func:`~stockroom.sources.schemas.stored_schema`).
    ``predate`` declares, per table, columns that no file has, so that they aren't
    asked for at all.
    """
    names = tables or list(SCHEMAS)
    absent = predate or {}

    def reader(name: str):
        def build(t: Tables) -> DataFrame:
            path = os.path.join(root, name)
            return evolve_schema(t.spark.read.schema(stored_schema(name, absent.get(name))).parquet(path), name)
        return build

    return Tables(spark, {n: reader(n) for n in names})


def write_tables(t: Tables, root: str, tables: list[str] | None = None) -> None:
    """Write canonical tables as parquet; fact tables partitioned by store.

    Rows of a store are brought together first (a large store in several
    tasks), so files follow the data's size and not tasks times stores.
    """
    for name in tables or [n for n in SCHEMAS if n in t]:
        df = t[name]
        if "store_id" in df.columns and name in ("products", "sales", "purchases", "inventory_transactions"):
            writer = df.hint("rebalance", "store_id").write.mode("overwrite").partitionBy("store_id")
        else:
            writer = df.write.mode("overwrite")
        writer.parquet(os.path.join(root, name))


def stage_inputs(t: Tables, root: str, names: list[str] | None = None) -> Tables:
    """Write every input frame of ``t`` (canonical tables and request batches)
    as parquet under ``root`` and return a bundle that reads them back.

    This is the production shape: operators read stored tables instead of
    re-deriving them. Raw source tables are not copied.
    """
    from . import fixture_sql
    names = names or [n for n in t.names() if n not in fixture_sql.RAW_TABLES]
    for n in names:
        t[n].write.mode("overwrite").parquet(os.path.join(root, n))

    def reader(name: str):
        return lambda tt: tt.spark.read.parquet(os.path.join(root, name))

    builders = {n: reader(n) for n in names}
    for raw in fixture_sql.RAW_TABLES:
        if raw in t:
            builders[raw] = t._builders[raw]
    return Tables(t.spark, builders)


def read_jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
                    num_partitions: int, properties: dict | None = None) -> DataFrame:
    """Parallel read of one table of a live database (untested here: no database
    may run in this environment). ``num_partitions`` range queries over
    ``partition_column`` in [lower, upper) run as separate tasks; the result is
    conformed with :func:`evolve_schema` when ``table`` is canonical.
    """
    df = spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                         numPartitions=num_partitions, properties=properties or {})
    return evolve_schema(df, table) if table in SCHEMAS else df
