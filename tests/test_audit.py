"""Golden cases for the audit ledger (FIXTURES.md §3, 'changes')."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from stockroom.operators import ledger as G
from stockroom.sources.changes import LINE_CHANGE
from stockroom.sources.schemas import evolve_schema

D = Decimal
AT = dt.datetime(2024, 1, 1)


def _changes(spark, rows):
    def img(x):
        return None if x is None else dict(zip(["id", "order_id", "product_id", "quantity", "unit_price"], x))
    data = [(cid, tbl, op, img(b), img(a), store, user, AT) for cid, tbl, op, b, a, store, user in rows]
    return spark.createDataFrame(data, LINE_CHANGE)


def _products(spark):
    return evolve_schema(spark.createDataFrame([(100, 1, "apple"), (200, 2, "kiwi")],
                                               "id long, store_id long, name string"), "products")


def test_line_audit_signs_notes_and_store_check(spark):
    ch = _changes(spark, [
        (1, "sale_items", "I", None, (11, 5, 100, 3, D("2.00")), 1, 7),
        (2, "sale_items", "U", (11, 5, 100, 3, D("2.00")), (11, 5, 100, 5, D("2.00")), 1, 7),
        (3, "sale_items", "D", (11, 5, 100, 5, D("2.00")), None, 1, 7),
        (4, "purchase_items", "U", (21, 6, 100, 4, D("1.00")), (21, 6, 100, 6, D("1.50")), 1, 8),
        (5, "sale_items", "I", None, (12, 5, 200, 1, D("9.00")), 1, 7),   # product of another store
    ])
    ok, bad = G.audit_line_entries(ch, _products(spark))
    got = {r["change_id"]: (r["type"], r["quantity"], r["unit_price"], r["notes"], r["reference_id"])
           for r in ok.collect()}
    assert got == {
        1: ("sale_item_created", -3, D("2.00"), "Sale item created", 5),
        2: ("sale_item_updated", -2, D("2.00"), "Sale item updated", 5),     # old - new
        3: ("sale_item_deleted", 5, D("2.00"), "Sale item deleted", 5),
        4: ("purchase_item_updated", 2, D("1.50"), "Purchase item updated", 6),  # new - old, new price
    }
    assert [(r["change_id"], r["reason"]) for r in bad.collect()] == [(5, "Product not found")]
    # the stock ledger sums to the stock change; the audit log is not meant to
    stock = {r["product_id"]: r["quantity_on_hand"] for r in G.stock_on_hand(
        _products(spark).withColumn("quantity", F.lit(10)), G.stock_ledger(ch)).collect()}
    assert stock == {100: 10 - 3 - 2 + 5 + 2, 200: 10 - 1}


def test_header_update_logs_every_line_and_rejects_foreign_products(spark):
    heads = spark.createDataFrame(
        [(1, "sales", "I", 5, 1, 7, None, AT), (2, "sales", "U", 5, 1, 7, None, AT),
         (3, "sales", "U", 6, 1, 7, None, AT), (4, "sales", "D", 5, 1, 7, None, AT)],
        "change_id long, tbl string, op string, header_id long, store_id long, user_id long, party_id long, "
        "ts timestamp_ntz")
    lines = spark.createDataFrame([(11, 5, 100, 3, D("2.00")), (12, 5, 100, 1, D("2.00")),
                                   (13, 6, 200, 1, D("9.00"))],
                                  "id long, sale_id long, product_id long, quantity int, unit_price decimal(10,2)")
    ok, bad = G.audit_header_entries(heads, lines, _products(spark), "sale_id", "sale")
    got = sorted(((r["change_id"], r["type"], r["product_id"], r["quantity"], r["notes"]) for r in ok.collect()),
                 key=lambda x: tuple((v is not None, v) for v in x))
    assert got == [(1, "sale_created", None, None, "Sale created"),     # lines do not exist yet
                   (2, "sale_updated", None, None, "Sale updated"),
                   (2, "sale_updated", 100, -3, "Sale item"),            # full quantities again
                   (2, "sale_updated", 100, -1, "Sale item"),
                   (4, "sale_deleted", None, None, "Sale deleted")]      # lines already gone
    assert [(r["change_id"], r["reason"]) for r in bad.collect()] == [(3, "Product not found")]


def test_supplier_delete_uses_the_old_image(spark):
    sc = spark.createDataFrame([(1, "I", 9, 1, "Acme", 7), (2, "U", 9, 1, "Acme Ltd", 7), (3, "D", 9, 1, "Acme Ltd", 7)],
                               "change_id long, op string, id long, store_id long, name string, user_id long")
    got = sorted((r["change_id"], r["type"], r["notes"]) for r in G.audit_suppliers(sc).collect())
    assert got == [(1, "supplier_created", "Supplier Acme created"),
                   (2, "supplier_updated", "Supplier Acme Ltd updated"),
                   (3, "supplier_deleted", "Supplier Acme Ltd deleted")]


def test_quantity_change_default_note(spark):
    req = spark.createDataFrame([(1, 100, -2, D("2.00"), "adjustment", 7, None, None),
                                 (1, 100, 3, D("2.00"), "adjustment", 7, None, "counted"),
                                 (2, 100, 1, D("2.00"), "adjustment", 7, None, None)],
                                "store_id long, product_id long, quantity int, unit_price decimal(10,2), type string, "
                                "user_id long, reference_id long, notes string")
    ok, bad = G.quantity_change_entries(req, _products(spark))
    assert sorted(r["notes"] for r in ok.collect()) == ["Product apple quantity changed by -2", "counted"]
    assert [r["reason"] for r in bad.collect()] == ["Product not found"]
