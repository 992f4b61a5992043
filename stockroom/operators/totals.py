"""Order totals kept current from change records.

The totals of an order move with every change of its lines: by the new amount
less the old one, and by one item for a line that comes or goes. These signed
deltas are summed per order in one pass over the batch and merged into the stored
totals of the orders they name; no other order is read or written. A header that
comes makes its order known, one that is deleted takes its totals with it.

A record counts once, however often it is delivered: within a batch by its
``change_id``, across batches against the ids applied before. These are kept for a
``horizon`` before the latest record only, so they don't grow without end; a record
older than that which isn't among them can't be told from a replay and is returned
as late, not merged. Records without a ``change_id`` are all merged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import keep
from ..functions.money import money
from ..sources.schemas import TOTALS
from ..sources.snapshots import Change
from .ledger import drop_replays

LINES = {"sale": "sale_items", "purchase": "purchase_items"}
HEADERS = {"sale": "sales", "purchase": "purchases"}


@dataclass
class Merged:
    change: Change       # of the stored totals
    applied: DataFrame   # (change_id, ts) to be kept for the next batch
    late: DataFrame      # (change_id, ts) older than the horizon, not merged


def _amount(image: Column) -> Column:
    return F.coalesce(image["quantity"] * image["unit_price"], F.lit(0))


def line_deltas(changes: DataFrame) -> DataFrame:
    """(id, store_id, amount, items) per order that the line change records name."""
    order = F.coalesce(F.col("after.order_id"), F.col("before.order_id"))
    items = F.col("after").isNotNull().cast("bigint") - F.col("before").isNotNull().cast("bigint")
    return (changes.groupBy(order.alias("id"))
            .agg(F.max("store_id").alias("store_id"), money(F.sum(_amount(F.col("after")) - _amount(F.col("before")))).alias("amount"),
                 F.sum(items).cast("bigint").alias("items"))
            .filter(F.col("id").isNotNull()))


def _fresh(records: DataFrame, applied: DataFrame | None) -> DataFrame:
    records = drop_replays(records)
    return records if applied is None else records.join(applied.select("change_id").distinct(), "change_id", "left_anti")


def merge_totals(stored: DataFrame, line_changes: DataFrame, header_changes: DataFrame, kind: str,
                 applied: DataFrame | None = None, horizon: str | None = None) -> Merged:
    """What a batch of change records does to the ``stored`` totals of sales or purchases.

    ``header_changes`` has change_id, tbl, op, header_id, store_id and ts. ``applied`` holds the ids of earlier
    batches. Both kinds of records share one range of change ids per table, told apart by the table.
    """
    lines = line_changes.filter(F.col("table") == LINES[kind])
    heads = header_changes.filter(F.col("tbl") == HEADERS[kind])
    seen = lambda name: None if applied is None else applied.filter(F.col("tbl") == name)
    lines, heads = _fresh(lines, seen(LINES[kind])), _fresh(heads, seen(HEADERS[kind]))
    ids = (lines.select(F.lit(LINES[kind]).alias("tbl"), "change_id", "ts")
           .unionByName(heads.select(F.lit(HEADERS[kind]).alias("tbl"), "change_id", "ts")))
    late = ids.limit(0)
    if applied is not None:
        late_before = None
        if horizon is not None:
            late_before = applied.agg((F.max("ts") - F.expr(f"INTERVAL {horizon}")).alias("b")).first()["b"]
        if late_before is not None:
            late_before = F.lit(late_before).cast("timestamp_ntz")
            old = F.col("change_id").isNotNull() & (F.col("ts") < late_before)
            late, ids = ids.filter(old), ids.filter(~F.coalesce(old, F.lit(False)))
            lines, heads = (x.filter(~F.coalesce(old, F.lit(False))) for x in (lines, heads))
            applied = applied.filter(F.col("ts") >= late_before)
        ids = applied.select("tbl", "change_id", "ts").unionByName(ids)

    moved = line_deltas(lines)
    met = heads.groupBy(F.col("header_id").alias("id")).agg(
        F.max("store_id").alias("head_store"), F.max((F.col("op") == "I").cast("int")).alias("made"),
        F.max((F.col("op") == "D").cast("int")).alias("gone")).filter(F.col("id").isNotNull())
    touched = moved.join(met, "id", "full_outer")
    old = stored.select("id", F.col("store_id").alias("old_store"), "total_amount", "total_items", "known")
    rows = keep(touched.join(old, "id", "left"), "touched")
    zero = F.lit(0)
    upserts = rows.filter(F.coalesce("gone", zero) == 0).select(
        "id", F.coalesce("old_store", "head_store", "store_id").alias("store_id"),
        money(F.coalesce("total_amount", zero) + F.coalesce("amount", zero)).alias("total_amount"),
        (F.coalesce("total_items", zero) + F.coalesce("items", zero)).cast("bigint").alias("total_items"),
        (F.coalesce("known", F.lit(False)) | (F.coalesce("made", zero) == 1)).alias("known"))
    removed = rows.filter(F.col("gone") == 1).select("id")
    return Merged(Change(upserts.select(*TOTALS.names), removed), ids, late)


def current_totals(stored: DataFrame, key: str) -> DataFrame:
    """The totals of all orders whose header is there, as :func:`~stockroom.operators.reports.sale_totals` gives them."""
    return stored.filter("known").select(F.col("id").alias(key), "store_id", "total_amount", "total_items")
