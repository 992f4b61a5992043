"""Registered source and sink queries (§2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.documents import sale_documents
from ..operators.ledger import STOCK_RULES, STOCK_UPDATE_RULES, stock_ledger
from ..session import scratch_dir
from ..sources.schemas import SCHEMAS
from ..sources.sinks import append_ledger, export_json, read_ledger, to_json_documents
from ..sources.tables import load_tables, write_tables
from .ledger_plans import changes
from .registry import register

# the mapped tables; the ledger has queries of its own
STORED = [n for n in SCHEMAS if n != "inventory_transactions"]
LEDGER_TYPES = [r[0] for r in (*STOCK_RULES.values(), *STOCK_UPDATE_RULES.values())]


def _load(name):
    """Write one canonical table as parquet, read it back with its fixed schema."""
    def run(t):
        root = scratch_dir(t.spark, "tables")
        write_tables(t, root, [name])
        return load_tables(t.spark, root, [name])[name]
    return run


def _load_old(t):
    """A sales table stored before the schema updates, read with the declared defaults."""
    root = scratch_dir(t.spark, "tables")
    added = ["payment_status", "discount", "tax", "last_updated_at"]
    t.sales.drop(*added).write.parquet(f"{root}/sales")
    return load_tables(t.spark, root, ["sales"], {"sales": added}).sales


def _append_ledger(t):
    """One batch per movement type appended to the ledger table, read back."""
    path = scratch_dir(t.spark, "ledger")
    ch = changes(t)
    for kind in LEDGER_TYPES:
        append_ledger(stock_ledger(ch, types=[kind]), path)
    return read_ledger(t.spark, path)


def _export_json(t):
    """Sale documents exported as JSON lines, read back with their schema."""
    path = scratch_dir(t.spark, "export")
    docs = sale_documents(t)
    export_json(docs, path)
    return t.spark.read.schema(docs.schema).json(path)


def _json_documents(t):
    """Sale documents as JSON texts, parsed again with their schema."""
    docs = sale_documents(t)
    parsed = F.from_json("json", docs.schema)
    return to_json_documents(docs).select(parsed.alias("d")).select("d.*")


register("load_tables")(_load("products"))
for _name in STORED:
    if _name != "products":
        register(f"load_tables_{_name}")(_load(_name))
register("load_tables_old_sales")(_load_old)
register("append_ledger")(_append_ledger)
register("export_json")(_export_json)
register("json_documents")(_json_documents)
