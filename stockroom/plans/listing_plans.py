"""Registered listing, detail and document queries (§2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import listings as L
from .registry import RANGE_END, RANGE_START, register

# Fixed parameters of the registered listing queries (shared with the oracle).
PRODUCT_SEARCH, MIN_PRICE, MAX_PRICE = "WIDGET", 900, 1500
WILDCARD_SEARCH = "%b_lt"
PAYMENT_METHOD = "1-URGENT"
SUPPLIER_SEARCH, SUPPLIER_PAGE, SUPPLIER_LIMIT = "supplier", 2, 2
SP_START, SP_PAGE, SP_LIMIT = "1996-06-01", 2, 5
# Pages beyond the first NEAR rows of their group are found by rank; PAST's page is empty for all.
NEAR, LATE_PAGE, LATE_LIMIT, PAST_PAGE = 4, 3, 3, 1_000_000

register("list_products")(lambda t: L.list_products(
    t, search=PRODUCT_SEARCH, min_price=MIN_PRICE, max_price=MAX_PRICE, in_stock="true"))
register("list_products_all")(lambda t: L.list_products(t))
register("list_products_out_of_stock")(lambda t: L.list_products(t, search=WILDCARD_SEARCH, in_stock="false"))
register("list_products_category")(lambda t: L.list_products(t, store_id=3, category_id=313))
register("product_detail")(lambda t: L.product_detail(t, t.product_keys))
register("list_reviews")(lambda t: L.list_reviews(t))
register("list_sales")(lambda t: L.list_sales(t, start=RANGE_START, end=RANGE_END, payment_method=PAYMENT_METHOD))
register("list_sales_all")(lambda t: L.list_sales(t))
register("sale_documents")(lambda t: D.sale_documents(t))
register("sale_documents_after_update")(lambda t: D.sale_documents(t, with_user=False))
register("sale_items_detail")(lambda t: L.sale_items_detail(t))
register("list_purchases")(lambda t: L.list_purchases(t, start=RANGE_START, end=RANGE_END))
register("list_purchases_all")(lambda t: L.list_purchases(t))
register("purchase_documents")(lambda t: D.purchase_documents(t))
register("purchase_documents_after_update")(lambda t: D.purchase_documents(t, with_user=False))
register("purchase_items_detail")(lambda t: L.purchase_items_detail(t))
register("list_suppliers")(lambda t: L.list_suppliers(
    t, search=SUPPLIER_SEARCH, page_no=SUPPLIER_PAGE, limit=SUPPLIER_LIMIT))
register("list_suppliers_store")(lambda t: L.list_suppliers(t, store_id=3, page_no=1, limit=10))
register("supplier_page_info")(lambda t: L.supplier_page_info(t, page_no=SUPPLIER_PAGE, limit=SUPPLIER_LIMIT))
register("supplier_detail")(lambda t: L.supplier_detail(t, t.supplier_keys))
register("supplier_purchases")(lambda t: L.supplier_purchases(t, start=SP_START, page_no=SP_PAGE, limit=SP_LIMIT))
register("supplier_purchases_count")(lambda t: L.supplier_purchases_count(
    t, start=SP_START, page_no=SP_PAGE, limit=SP_LIMIT))
register("list_categories")(lambda t: L.list_categories(t))
register("category_detail")(lambda t: L.category_detail(t, t.category_keys))
register("user_stores")(lambda t: L.user_stores(t))
register("store_detail")(lambda t: L.store_detail(t, t.store_pairs))
register("store_users")(lambda t: L.store_users(t))
register("list_suppliers_late_page")(lambda t: L.list_suppliers(
    t, page_no=LATE_PAGE, limit=LATE_LIMIT, near_rows=NEAR))
register("list_suppliers_store_late_page")(lambda t: L.list_suppliers(
    t, store_id=3, page_no=SUPPLIER_PAGE, limit=SUPPLIER_LIMIT, near_rows=0))
register("supplier_purchases_late_page")(lambda t: L.supplier_purchases(
    t, start=SP_START, page_no=LATE_PAGE, limit=LATE_LIMIT, near_rows=NEAR))


@register("supplier_purchases_past_end")
def _past_end(t):
    """A page behind every supplier's last one: each envelope with the number of rows on the page."""
    page = L.supplier_purchases(t, start=SP_START, page_no=PAST_PAGE, limit=LATE_LIMIT)
    n = page.groupBy("store_id", "supplier_id").agg(F.count(F.lit(1)).alias("_n"))
    info = L.supplier_purchases_count(t, start=SP_START, page_no=PAST_PAGE, limit=LATE_LIMIT)
    return info.join(n, ["store_id", "supplier_id"], "left").select(
        *info.columns, F.coalesce("_n", F.lit(0).cast("bigint")).alias("rows_on_page"))
