"""Registered ledger queries (§2.12 batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as G
from ..operators.listings import list_transactions
from ..operators.orders import next_products
from ..sources.changes import line_change_records
from .registry import register

AS_OF = "2024-06-30 00:00:00"  # NOW() of the direct quantity changes


def changes(t):
    return line_change_records(t.line_changes)


def stock_ledger(t):
    return G.stock_ledger(changes(t))


register("ledger_sale")(lambda t: G.stock_ledger(changes(t), types=["sale"]))
register("ledger_purchase")(lambda t: G.stock_ledger(changes(t), types=["purchase"]))
register("ledger_sale_reversal")(lambda t: G.stock_ledger(changes(t), types=["sale_reversal"]))
register("ledger_purchase_reversal")(lambda t: G.stock_ledger(changes(t), types=["purchase_reversal"]))
register("stock_ledger")(stock_ledger)
register("stock_on_hand")(lambda t: G.stock_on_hand(t.products, stock_ledger(t)))
def stock_reconciliation(t):
    """The snapshot after the movements, with some rows altered, removed and added, against opening plus ledger."""
    after = next_products(t.products, changes(t))
    drifted = t.stored_products.select("id", (F.col("quantity") - F.col("opening")).alias("drift"), "known")
    stored = after.join(drifted, "id").select(
        "id", "store_id", (F.col("quantity") + F.col("drift")).cast("int").alias("quantity"))
    unknown = t.stored_products.filter("NOT known").select("id", "store_id", "quantity")
    return G.stock_reconciliation(stored.unionByName(unknown), t.products, stock_ledger(t))


register("stock_reconciliation")(stock_reconciliation)
register("audit_sale_items")(
    lambda t: G.audit_line_entries(changes(t).filter(F.col("table") == "sale_items"), t.products)[0])
register("audit_purchase_items")(
    lambda t: G.audit_line_entries(changes(t).filter(F.col("table") == "purchase_items"), t.products)[0])
register("audit_line_rejects")(lambda t: G.audit_line_entries(changes(t), t.products)[1])
register("audit_sale_headers")(
    lambda t: G.audit_header_entries(t.header_changes, t.sale_items, t.products, "sale_id", "sale")[0])
register("audit_sale_header_rejects")(
    lambda t: G.audit_header_entries(t.header_changes, t.sale_items, t.products, "sale_id", "sale")[1])
register("audit_purchase_headers")(
    lambda t: G.audit_header_entries(t.header_changes, t.purchase_items, t.products, "purchase_id",
                                     "purchase", t.suppliers)[0])
register("audit_purchase_header_rejects")(
    lambda t: G.audit_header_entries(t.header_changes, t.purchase_items, t.products, "purchase_id",
                                     "purchase", t.suppliers)[1])
register("audit_suppliers")(lambda t: G.audit_suppliers(t.supplier_changes))
register("quantity_change_entries")(lambda t: G.quantity_change_entries(t.quantity_changes, t.products, AS_OF)[0])
register("quantity_change_rejects")(lambda t: G.quantity_change_entries(t.quantity_changes, t.products, AS_OF)[1])
register("list_transactions")(lambda t: list_transactions(stock_ledger(t), store_id=7))
register("product_transactions")(lambda t: list_transactions(stock_ledger(t), product_id=107))
