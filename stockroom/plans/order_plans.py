"""Registered order write-path queries (§2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import largest
from ..operators import orders as O
from ..operators.ledger import stock_ledger
from .registry import register

AS_OF = "2024-06-30 00:00:00"  # NOW() of the batch


def sale_requests(t) -> DataFrame:
    t = t.written("sale_request_headers")  # their lines are found by them
    return O.nest_items(t.sale_request_headers, t.sale_request_lines, "request_id", O.PART_LINES)


def verdicts(out, key: str = "request_id") -> DataFrame:
    """(key, status, reason) for every request of an outcome."""
    acc = out.keys.select(key, F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reason"))
    rej = out.rejects.select(key, F.lit("rejected").alias("status"), "reason")
    return acc.unionByName(rej)


def _post_sales(t):
    return O.post_sales(sale_requests(t), t, t.user_store, AS_OF)


register("post_sales")(lambda t: _post_sales(t).rows)
register("post_sales_lines")(lambda t: _post_sales(t).ledger)
register("post_sales_verdicts")(lambda t: verdicts(_post_sales(t)))


def _post_single_lines(t):
    # the batch picks its lines from all requested ones, twice, and its headers by those lines
    b = t.written("sale_request_headers", "sale_request_lines", "single_sale_request_lines")
    req = O.nest_items(b.single_sale_request_headers, b.single_sale_request_lines, "request_id", O.PART_LINES)
    return verdicts(O.post_sales(req, t, t.user_store, AS_OF))


register("post_sales_single_line")(_post_single_lines)


def purchase_requests(t) -> DataFrame:
    return O.nest_items(t.purchase_request_headers, t.purchase_request_lines, "request_id", O.PART_LINES)


def _post_purchases(t):
    return O.post_purchases(purchase_requests(t), t, t.user_store, AS_OF)


def _post_sales_ledger(t):
    """The posted sales' change records, delivered twice, through the de-duplicating ledger."""
    ch = _post_sales(t).extra
    return stock_ledger(ch.unionByName(ch), dedupe=True)


register("post_sales_ledger")(_post_sales_ledger)
register("post_sales_products")(lambda t: O.next_products(t.products, _post_sales(t).extra, AS_OF))


def _purchase_chain(t):
    """Two purchase batches in a row, the second over the tables that the first left."""
    t = t.written("user_store", "purchases", "purchase_items")  # both batches are made from them and posted to them
    first = _post_purchases(t)
    t2 = t.replace(purchases=t.purchases.unionByName(first.rows),
                   purchase_items=t.purchase_items.unionByName(first.ledger),
                   products=O.next_products(t.products, first.extra, AS_OF)).written("products")
    second = O.post_purchases(O.nest_items(t.bulk_purchase_headers, t.bulk_purchase_lines, "request_id", O.PART_LINES),
                              t2, t.user_store, AS_OF, last_change_id=largest(first.extra, "change_id"))
    return first, second, t2


def _chain_lines(t):
    first, second, _ = _purchase_chain(t)
    return first.ledger.unionByName(second.ledger)


def _chain_changes(t):
    first, second, _ = _purchase_chain(t)
    return first.extra.unionByName(second.extra).select("change_id", F.col("after.id").alias("line_id"))


def _chain_products(t):
    _, second, t2 = _purchase_chain(t)
    return O.next_products(t2.products, second.extra, AS_OF)


register("post_purchases_chain")(_chain_lines)
register("post_purchases_chain_changes")(_chain_changes)
register("post_purchases_chain_products")(_chain_products)
register("post_purchases")(lambda t: _post_purchases(t).rows)
register("post_purchases_lines")(lambda t: _post_purchases(t).ledger)
register("post_purchases_rejects")(lambda t: _post_purchases(t).rejects)


def _updates(t, kind):
    # the batch and the operator read the stored orders and lines several times
    t = t.written(f"{kind}s", f"{kind}_items")
    if kind == "sale":
        req = O.nest_items(t.sale_update_headers, t.sale_update_lines, "sale_id")
        return O.apply_sale_updates(req, t, t.user_store, AS_OF)
    req = O.nest_items(t.purchase_update_headers, t.purchase_update_lines, "purchase_id")
    return O.apply_purchase_updates(req, t, t.user_store, AS_OF)


def _reversals(t, kind):
    if kind == "sale":
        return O.reverse_sales(t.sale_reversals, t, t.user_store, AS_OF)
    return O.reverse_purchases(t.purchase_reversals, t, t.user_store, AS_OF)


for _kind in ("sale", "purchase"):
    register(f"apply_{_kind}_updates")((lambda k: lambda t: _updates(t, k).rows)(_kind))
    register(f"apply_{_kind}_updates_lines")((lambda k: lambda t: _updates(t, k).ledger)(_kind))
    register(f"apply_{_kind}_updates_stock")((lambda k: lambda t: O.stock_delta(_updates(t, k).extra))(_kind))
    register(f"apply_{_kind}_updates_rejects")((lambda k: lambda t: _updates(t, k).rejects)(_kind))
    register(f"reverse_{_kind}s")((lambda k: lambda t: _reversals(t, k).rows)(_kind))
    register(f"reverse_{_kind}s_lines")((lambda k: lambda t: _reversals(t, k).ledger)(_kind))
    register(f"reverse_{_kind}s_stock")((lambda k: lambda t: O.stock_delta(_reversals(t, k).extra))(_kind))
    register(f"reverse_{_kind}s_rejects")((lambda k: lambda t: _reversals(t, k).rejects)(_kind))
