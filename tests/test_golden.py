"""Hand-made frames for the source's documented behaviours (FIXTURES.md §3)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from stockroom.functions import filters as flt
from stockroom.operators import access as A
from stockroom.operators import catalog as K
from stockroom.operators import checks as C
from stockroom.operators import reports as R
from stockroom.sources.schemas import evolve_schema


def test_stock_status_keeps_source_order(spark, t_small):
    p = spark.createDataFrame([(1, None), (2, -1), (3, 0), (4, 9), (5, 10)], "id long, quantity int")
    p = evolve_schema(p.withColumn("store_id", F.lit(1)).withColumn("name", F.lit("x")), "products")
    got = {r["product_id"]: r["stock_status"] for r in R.inventory_report(t_small.replace(products=p)).collect()}
    # '< 10' is tested before '= 0': 'Out of Stock' never appears; NULL is 'In Stock'
    assert got == {1: "In Stock", 2: "Low Stock", 3: "Low Stock", 4: "Low Stock", 5: "In Stock"}


def test_date_only_end_bound_excludes_rest_of_day(spark):
    d = spark.createDataFrame([(1, dt.datetime(2024, 1, 31, 0, 0, 0)), (2, dt.datetime(2024, 1, 31, 23, 59, 59))],
                              "id long, created_at timestamp_ntz")
    listing = {r["id"] for r in flt.where(d, flt.ts_range("created_at", "2024-01-01", "2024-01-31")).collect()}
    report = {r["id"] for r in d.filter(flt.date_between("created_at", "2024-01-01", "2024-01-31")).collect()}
    assert listing == {1}
    assert report == {1, 2}
    bound_ts = {r["id"] for r in flt.where(d, flt.ts_range("created_at", None, "2024-01-31 23:59:59")).collect()}
    assert bound_ts == {1, 2}


def test_search_is_case_insensitive_with_wildcards(spark):
    d = spark.createDataFrame([(1, "Big BOLT", None), (2, "nut", "50% off"), (3, "b_lt", "x"), (4, "bXlt", None)],
                              "id long, name string, description string")
    got = lambda term: {r["id"] for r in d.filter(flt.search_any(["name", "description"], term)).collect()}
    assert got("bolt") == {1}
    assert got("50%") == {2}
    assert got("b_lt") == {1, 3, 4}      # '_' matches any one character
    assert flt.search_any(["name"], None) is None


def test_overall_report_for_store_without_sales_has_one_row(t_small):
    rows = R.sales_report_overall(t_small, store_id=999).collect()
    assert len(rows) == 1 and rows[0]["total_sales"] == 0 and rows[0]["total_revenue"] is None


def test_category_update_null_description_overwrites(spark, t_small):
    cats = spark.createDataFrame([(1, 1, "Tools", "old text", None)],
                                 "id long, store_id long, name string, description string, created_at timestamp_ntz")
    t = t_small.replace(categories=cats)
    req = spark.createDataFrame([(1, 1, "TOOLS", None), (1, 2, "x", "y")],
                                "store_id long, id long, name string, description string")
    out = K.update_categories(req, t)
    assert [(r["name"], r["description"]) for r in out.rows.collect()] == [("TOOLS", None)]
    assert [r["reason"] for r in out.rejects.collect()] == ["Category not found"]


def test_supplier_names_clash_case_insensitively(spark, t_small):
    sup = evolve_schema(spark.createDataFrame([(1, 1, "Acme"), (2, 1, "Other")], "id long, store_id long, name string"),
                        "suppliers")
    t = t_small.replace(suppliers=sup)
    req = spark.createDataFrame(
        [(1, 7, 10, "ACME"), (2, 7, 11, "ACME"), (1, 7, 12, "Fresh"), (1, 7, 13, "fresh")],
        "store_id long, user_id long, request_id long, name string")
    out = K.register_suppliers(req, t)
    assert sorted(r["request_id"] for r in out.keys.collect()) == [11, 12]
    assert {r["request_id"]: r["reason"] for r in out.rejects.collect()} == {
        10: K.DUPLICATE_SUPPLIER, 13: K.DUPLICATE_SUPPLIER}
    assert [r["notes"] for r in out.ledger.orderBy("notes").collect()] == [
        "Supplier ACME created", "Supplier Fresh created"]
    # renaming a supplier to its own name (other case) is no clash; to another's name is
    patch = spark.createDataFrame([(1, 1, 7, "ACME"), (1, 2, 7, "acme")],
                                  "store_id long, id long, user_id long, name string")
    p = K.patch_suppliers(patch, t)
    assert [r["id"] for r in p.rows.collect()] == [1]
    assert [r["notes"] for r in p.ledger.collect()] == ["Supplier Acme updated"]   # the old name
    assert [r["reason"] for r in p.rejects.collect()] == [K.DUPLICATE_SUPPLIER]


def test_membership_checks_in_order(spark, t_small):
    users = spark.createDataFrame([(1, "a", "a@x.y")], "user_id long, name string, email string")
    stores = t_small.store
    req = spark.createDataFrame([(2, 1, "staff"), (1, 999, "cashier"), (1, 1, "cashier"), (1, 1, "manager")],
                                "user_id long, store_id long, role string")
    ok, bad = A.accept_user_requests(req, users, stores)
    assert [tuple(r) for r in ok.collect()] == [(1, 1, "manager")]
    assert sorted(r["reason"] for r in bad.collect()) == ["Invalid role", "Store does not exist",
                                                          "User does not exist"]


def test_authorize_roles(spark):
    us = spark.createDataFrame([(1, 1, "cashier"), (2, 1, "staff")], "user_id long, store_id long, role string")
    req = spark.createDataFrame([(1, 1, "create_sale"), (2, 1, "create_sale"), (2, 1, "list_sales"),
                                 (3, 1, "list_sales"), (1, 1, "fly")], "user_id long, store_id long, action string")
    got = [(r["user_id"], r["action"], r["reason"]) for r in A.authorize_requests(req, us).collect()]
    assert sorted(got, key=str) == sorted([(1, "create_sale", None), (2, "create_sale", A.INSUFFICIENT),
                                           (2, "list_sales", None), (3, "list_sales", A.ACCESS_DENIED),
                                           (1, "fly", "Unknown action")], key=str)


def test_product_and_review_checks(spark):
    raw = spark.createDataFrame([("a", "B1", "0", "1.5"), (" ", "", "-1", "x"), ("b", "B2", "1.5", "-0.1")],
                                "name string, barcode string, quantity string, price string")
    errs = [r["errors"] for r in C.check_products(raw).collect()]
    assert errs[0] == []
    assert errs[1] == [C.MSG["product_name"], C.MSG["barcode"], C.MSG["quantity"], C.MSG["unit_price"]]
    assert errs[2] == [C.MSG["quantity"], C.MSG["unit_price"]]
    rev = spark.createDataFrame([(r, "t") for r in ["0", "1", "5", "6", "x", "", None]] + [("3", " ")],
                                "rating string, review_text string")
    bad = [bool(r["errors"]) for r in C.check_reviews(rev).collect()]
    assert bad == [True, False, False, True, True, True, True, True]


def test_money_is_exact_decimal(spark, t_small):
    p = evolve_schema(spark.createDataFrame([(1, 1, 3, Decimal("0.10")), (2, 1, 7, Decimal("0.20"))],
                                            "id long, store_id long, quantity int, price decimal(10,2)"), "products")
    rows = R.inventory_valuation(t_small.replace(products=p)).collect()
    assert sorted(r["total_value"] for r in rows) == [Decimal("0.30"), Decimal("1.40")]


def test_views_are_queryable_with_sql(spark, t_small):
    from stockroom.operators.views import register_views
    names = register_views(t_small, prefix="t_")
    assert len(names) == 5
    n = spark.sql("SELECT count(*) AS n FROM t_low_stock_view WHERE quantity < 10").collect()[0]["n"]
    assert n == R.low_stock(t_small).count()


def test_report_procedures_as_sql_table_functions(spark, t_small):
    from stockroom.operators.views import register_report_functions
    register_report_functions(t_small, prefix="t_")
    got = spark.sql("SELECT * FROM t_generate_inventory_report(3)").collect()
    want = R.inventory_report(t_small, store_id=3).collect()
    assert [(r["product_name"], r["stock_status"]) for r in got] == [(r["product_name"], r["stock_status"])
                                                                     for r in want]
    got = spark.sql("SELECT * FROM t_generate_sales_report(3, DATE'1996-01-01', DATE'1998-12-31')").collect()
    want = R.sales_report_range(t_small, "1996-01-01", "1998-12-31", store_id=3).collect()
    assert sorted(tuple(r) for r in got) == sorted((r["sale_date"], r["product_name"], r["total_quantity"],
                                                    r["total_amount"]) for r in want)


def test_paging_parameters_are_validated(t_small):
    import pytest
    from stockroom.operators import listings as L
    for bad in [(0, 10), (1, 0), (-1, 5)]:
        with pytest.raises(ValueError):
            L.list_suppliers(t_small, page_no=bad[0], limit=bad[1])
        with pytest.raises(ValueError):
            L.supplier_page_info(t_small, page_no=bad[0], limit=bad[1])
    assert L.list_suppliers(t_small, store_id=1, page_no=1, limit=1).count() <= 1
