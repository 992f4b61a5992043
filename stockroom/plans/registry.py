"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry runs one operator over the whole test tables of ``sf_dir`` with
the parameters a user of the reports would pass. The same names carry an
equivalent DuckDB SQL text in :mod:`stockroom.plans.oracle`.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_result_conf
from ..sources.tables import Tables, from_testdata

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
# the same queries over a Tables bundle (e.g. stored canonical tables)
OPS: dict[str, Callable[[Tables], DataFrame]] = {}

# Fixed parameters of the registered queries (shared with the oracle text).
RANGE_START, RANGE_END = "1996-01-01", "1998-12-31"
BOUND_START, BOUND_END = "1996-01-01", "2000-12-31"


_TABLES: dict[tuple, Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The bundle for ``sf_dir``, shared by queries of one session.

    Frames are lazy and immutable, so sharing only saves re-building and
    re-analysing the mapping; every query still reads the files when it runs.
    """
    apply_result_conf(spark)
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = from_testdata(spark, sf_dir)
    return _TABLES[key]


def register(name: str):
    def deco(fn: Callable[[Tables], DataFrame]):
        OPS[name] = fn
        REGISTRY[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        REGISTRY[name].__doc__ = fn.__doc__
        return fn
    return deco


def _load_all() -> None:
    # Importing the plan modules fills REGISTRY.
    for module in ("report_plans", "listing_plans", "ledger_plans", "catalog_plans", "order_plans",
                   "check_plans", "access_plans", "stream_plans", "source_plans", "snapshot_plans", "sql_plans"):
        importlib.import_module(f"{__package__}.{module}")


def ops() -> dict[str, Callable[[Tables], DataFrame]]:
    _load_all()
    return dict(OPS)


def queries() -> dict[str, QueryFn]:
    _load_all()  # imports are idempotent; a plan module imported alone must not hide the rest
    return dict(REGISTRY)
