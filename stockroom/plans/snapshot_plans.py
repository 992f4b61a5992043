"""Registered queries that write batch results over stored tables (§2.11), keep totals current (§2.2) and
read files of two ages (§2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import keep
from ..operators import orders as O
from ..operators.totals import HEADERS, LINES, current_totals, merge_totals
from ..session import scratch_dir
from ..sources.schemas import TOTALS
from ..sources.snapshots import apply_batch, read_stored, write_stored
from ..sources.tables import load_tables
from .ledger_plans import changes
from .order_plans import AS_OF, purchase_requests, sale_requests
from .registry import register


def _after_batch(t, kind: str, post):
    """Products, orders and lines as stored after a batch that is run twice under one id."""
    names = ["products", f"{kind}s", f"{kind}_items"]
    root = scratch_dir(t.spark, "snapshot")
    write_stored(t, root, names)
    for _ in range(2):
        apply_batch(t.spark, root, "batch-1", names,
                    lambda live: O.batch_changes(post(t.replace(**{n: live[n] for n in names})), live, kind, AS_OF))
    live = read_stored(t.spark, root, names)
    products, heads, lines = (live[n] for n in names)
    none = F.lit(None)
    return (products.select(F.lit("products").alias("tbl"), "id", "store_id", none.cast("bigint").alias("order_id"),
                            none.cast("bigint").alias("product_id"), "quantity", F.col("price").alias("amount"),
                            F.col("updated_at").alias("at"))
            .unionByName(heads.select(F.lit(f"{kind}s").alias("tbl"), "id", "store_id", none.cast("bigint").alias("order_id"),
                                      none.cast("bigint").alias("product_id"), none.cast("int").alias("quantity"),
                                      none.cast("decimal(10,2)").alias("amount"), F.col("created_at").alias("at")))
            .unionByName(lines.select(F.lit(f"{kind}_items").alias("tbl"), "id", none.cast("bigint").alias("store_id"),
                                      F.col(f"{kind}_id").alias("order_id"), "product_id", "quantity",
                                      F.col("unit_price").alias("amount"), none.cast("timestamp_ntz").alias("at"))))


register("post_sales_snapshot")(lambda t: _after_batch(
    t, "sale", lambda live: O.post_sales(sale_requests(t), live, t.user_store, AS_OF)))
register("post_purchases_snapshot")(lambda t: _after_batch(t, "purchase", lambda live: O.post_purchases(
    purchase_requests(t), live, t.user_store, AS_OF)))
register("apply_sale_updates_snapshot")(lambda t: _after_batch(t, "sale", lambda live: O.apply_sale_updates(
    O.nest_items(t.sale_update_headers, t.sale_update_lines, "sale_id"), live, t.user_store, AS_OF)))
register("reverse_sales_snapshot")(lambda t: _after_batch(
    t, "sale", lambda live: O.reverse_sales(t.sale_reversals, live, t.user_store, AS_OF)))


def _current_totals(t, kind: str):
    """Totals after two batches of change records: all that came, then all that changed or went, with replays of both."""
    spark, name = t.spark, f"{kind}_totals"
    root = scratch_dir(spark, "totals")
    # the records as delivered; both batches and their replays are parts of them
    lines = keep(changes(t).filter(F.col("table") == LINES[kind]), "lines")
    heads = keep(t.header_changes.filter(F.col("tbl") == HEADERS[kind]), "heads")
    spark.createDataFrame([], TOTALS).write.partitionBy("store_id").parquet(f"{root}/{name}")
    came = (lines.filter("op = 'I'"), heads.filter("op = 'I'"))
    went = tuple(x.filter("op <> 'I'").unionByName(x.filter("change_id % 3 = 0")).unionByName(x.filter("change_id % 5 = 2"))
                 for x in (lines, heads))
    applied = None
    for k, (line_batch, head_batch) in enumerate((came, went)):
        # what was applied before is stored as well: it must not follow from tables that have moved on
        merged = merge_totals(read_stored(spark, root, [name])[name], line_batch, head_batch, kind, applied)
        apply_batch(spark, root, f"batch-{k}", [name], lambda live, m=merged: {name: m.change})
        merged.applied.write.parquet(f"{root}/applied/{k}")
        applied = spark.read.parquet(f"{root}/applied/{k}")
    return current_totals(read_stored(spark, root, [name])[name], f"{kind}_id")


register("sale_totals_current")(lambda t: _current_totals(t, "sale"))
register("purchase_totals_current")(lambda t: _current_totals(t, "purchase"))


def _mixed_sales(t):
    """Sales of which some files were written before the schema updates, and the others hold NULLs of their own."""
    root = scratch_dir(t.spark, "tables")
    t.sales.filter("id % 2 = 0").drop("payment_status", "discount", "tax", "last_updated_at").write.parquet(f"{root}/sales")
    new = t.sales.filter("id % 2 = 1").withColumns({
        "payment_status": F.when(F.col("id") % 3 == 0, F.col("payment_status")),
        "tax": F.when(F.col("id") % 5 == 0, F.lit(1).cast("decimal(10,2)"))})
    new.write.mode("append").parquet(f"{root}/sales")
    return load_tables(t.spark, root, ["sales"]).sales


register("load_tables_mixed_sales")(_mixed_sales)
