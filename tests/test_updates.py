"""Golden cases for order updates and reversals (FIXTURES.md §3)."""

import datetime as dt
from decimal import Decimal

from stockroom.operators import orders as O
from stockroom.sources.schemas import evolve_schema

D = Decimal


def _tables(spark, t_small, kind):
    heads = spark.createDataFrame([(1, 1, 50, 7, "old"), (2, 1, 51, 7, None)],
                                  f"id long, store_id long, {'customer_id' if kind == 'sale' else 'supplier_id'} long,"
                                  " user_id long, notes string")
    lines = spark.createDataFrame(
        [(11, 1, 100, 5, D("2.00")), (12, 1, 101, 3, D("1.00")), (13, 1, 102, 1, D("9.00")),
         (14, 1, 100, 2, D("2.50")), (21, 2, 100, 1, D("2.00"))],
        f"id long, {kind}_id long, product_id long, quantity int, unit_price decimal(10,2)")
    party = spark.createDataFrame([(50, 1), (51, 1), (60, 2)], "id long, store_id long")
    us = spark.createDataFrame([(7, 1, "manager")], "user_id long, store_id long, role string")
    if kind == "sale":
        return t_small.replace(sales=evolve_schema(heads, "sales"), sale_items=evolve_schema(lines, "sale_items"),
                               customers=party, user_store=us)
    return t_small.replace(purchases=evolve_schema(heads, "purchases"),
                           purchase_items=evolve_schema(lines, "purchase_items"), suppliers=party, user_store=us)


def _req(spark, kind, rows):
    p = "customer_id" if kind == "sale" else "supplier_id"
    extra = "payment_method string, " if kind == "sale" else ""
    schema = (f"{kind}_id long, store_id long, user_id long, {p} long, {extra}notes string, "
              "requested_at timestamp_ntz, items array<struct<product_id:long, quantity:int, unit_price:decimal(10,2)>>")
    return spark.createDataFrame(rows, schema)


def test_sale_update_line_diff(spark, t_small):
    t = _tables(spark, t_small, "sale")
    at = dt.datetime(2024, 1, 1)
    req = _req(spark, "sale", [
        # grow 100 (first match is line 11), keep 101, drop 102, add 103; line 14 (2nd of 100) untouched
        (1, 1, 7, None, None, None, at, [(100, 8, D("7.00")), (101, 3, D("7.00")), (103, 2, D("4.00"))]),
        (2, 1, 7, None, "card", "n", at, None),                    # header only
        (3, 1, 7, None, None, None, at, [(100, 1, D("1.00"))]),     # unknown sale
    ])
    out = O.apply_sale_updates(req, t, t.user_store, "2024-06-30 00:00:00")
    lines = {r["id"]: (r["product_id"], r["quantity"], r["unit_price"]) for r in out.ledger.collect()}
    assert lines == {11: (100, 8, D("2.00")),      # new quantity, old price kept
                     12: (101, 3, D("1.00")), 14: (100, 2, D("2.50")),
                     22: (103, 2, D("4.00"))}      # inserted at the request price
    delta = {r["product_id"]: r["delta"] for r in O.stock_delta(out.extra).collect()}
    assert delta == {100: -3, 101: 0, 102: 1, 103: -2}
    heads = {r["id"]: (r["payment_method"], r["notes"]) for r in out.rows.collect()}
    assert heads == {1: (None, "old"), 2: ("card", "n")}   # COALESCE patch
    assert sorted((r["sale_id"], r["reason"]) for r in out.rejects.collect()) == [
        (3, "Sale not found")]
    # several valid requests for one order in a batch are all rejected, with the reason
    two = _req(spark, "sale", [(2, 1, 7, None, "card", "n", at, None), (2, 1, 7, 50, None, None, at, None)])
    out2 = O.apply_sale_updates(two, t, t.user_store)
    assert [r["reason"] for r in out2.rejects.collect()] == [O.SEVERAL, O.SEVERAL]
    assert out2.rows.count() == 0
    # one that fails a check, or is asked by somebody without a membership, stands in no other's way
    mixed = _req(spark, "sale", [(2, 1, 7, None, "card", "n", at, None), (2, 1, 7, 60, None, None, at, None),
                                 (2, 1, 99, None, "no", None, at, None)])
    out3 = O.apply_sale_updates(mixed, t, t.user_store)
    assert sorted(r["reason"] for r in out3.rejects.collect()) == ["Access denied", "Invalid Customer"]
    assert [(r["id"], r["payment_method"]) for r in out3.rows.collect()] == [(2, "card")]
    bad = _req(spark, "sale", [(2, 1, 7, 60, None, None, at, None)])
    assert [r["reason"] for r in O.apply_sale_updates(bad, t, t.user_store).rejects.collect()] == [
        "Invalid Customer"]


def test_purchase_update_takes_new_price_and_opposite_sign(spark, t_small):
    t = _tables(spark, t_small, "purchase")
    at = dt.datetime(2024, 1, 1)
    req = _req(spark, "purchase", [(1, 1, 7, None, None, at, [(100, 8, D("7.00")), (101, 1, D("1.00"))])])
    out = O.apply_purchase_updates(req, t, t.user_store)
    lines = {r["id"]: (r["product_id"], r["quantity"], r["unit_price"]) for r in out.ledger.collect()}
    assert lines == {11: (100, 8, D("7.00")), 12: (101, 1, D("1.00")), 14: (100, 2, D("2.50"))}
    delta = {r["product_id"]: r["delta"] for r in O.stock_delta(out.extra).collect()}
    assert delta == {100: 3, 101: -2, 102: -1}


def test_duplicate_products_in_update_are_rejected(spark, t_small):
    t = _tables(spark, t_small, "sale")
    req = _req(spark, "sale", [(1, 1, 7, None, None, None, dt.datetime(2024, 1, 1),
                                [(100, 1, D("1.00")), (100, 2, D("1.00"))])])
    out = O.apply_sale_updates(req, t, t.user_store)
    assert [r["reason"] for r in out.rejects.collect()] == ["Duplicate product in items"]
    assert out.rows.count() == 0


def test_reversal_returns_stock_and_rejects_unknown(spark, t_small):
    t = _tables(spark, t_small, "sale")
    req = spark.createDataFrame([(1, 1, 7), (9, 1, 7), (2, 2, 7)], "sale_id long, store_id long, user_id long")
    out = O.reverse_sales(req, t, t.user_store)
    assert {r["id"] for r in out.rows.collect()} == {2}
    assert {r["id"] for r in out.ledger.collect()} == {21}
    assert {r["product_id"]: r["delta"] for r in O.stock_delta(out.extra).collect()} == {100: 7, 101: 3, 102: 1}
    assert sorted((r["sale_id"], r["reason"]) for r in out.rejects.collect()) == [
        (2, "Access denied"), (9, "Sale not found")]


def test_second_reversal_finds_no_order(spark, t_small):
    t = _tables(spark, t_small, "sale")
    req = spark.createDataFrame([(1, 1, 7), (1, 1, 7), (1, 1, 99)], "sale_id long, store_id long, user_id long")
    out = O.reverse_sales(req, t, t.user_store)
    assert {r["id"] for r in out.rows.collect()} == {2}
    assert sorted(r["reason"] for r in out.rejects.collect()) == ["Access denied", "Sale not found"]


def test_two_membership_rows_answer_a_request_once(spark, t_small):
    from stockroom.operators.access import authorize_requests
    us = spark.createDataFrame([(7, 1, "staff"), (7, 1, "manager")], "user_id long, store_id long, role string")
    got = authorize_requests(spark.createDataFrame([(7, 1)], "user_id long, store_id long"), us, "update_sale").collect()
    assert [(r["role"], r["allowed"]) for r in got] == [("manager", True)]


def test_records_without_change_id_are_never_replays(spark, t_small):
    from stockroom.operators.ledger import stock_ledger
    from stockroom.plans.ledger_plans import changes
    from pyspark.sql import functions as F
    ch = changes(t_small).withColumn("change_id", F.lit(None).cast("bigint"))
    assert stock_ledger(ch, dedupe=True).count() == stock_ledger(changes(t_small)).count()
