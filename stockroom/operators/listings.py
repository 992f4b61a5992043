"""Listings, detail lookups and paging (the read endpoints).

A request for one row becomes an operator over a set of rows: detail
lookups take a frame of ``(store_id, id)`` keys and semi-join it; listings
answer for all stores at once with optional filters, and paging is per
store (or per supplier), see :mod:`stockroom.functions.pages`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters as flt
from ..functions.money import count_rows, line_total, sum_money
from ..functions.pages import NEAR_ROWS, page_of_each
from ..sources.tables import Tables


def _user_cols(prefix: str = "user") -> list[Column]:
    return [F.col("u_name").alias(f"{prefix}_name"), F.col("u_email").alias(f"{prefix}_email")]


def _users(t: Tables) -> DataFrame:
    return t.users.select(F.col("user_id").alias("u_id"), F.col("name").alias("u_name"),
                          F.col("email").alias("u_email"))


# ---- products --------------------------------------------------------------

def _products_with_category(t: Tables, products: DataFrame | None = None) -> DataFrame:
    cats = t.categories.select(F.col("id").alias("c_id"), F.col("name").alias("category_name"))
    p = products if products is not None else t.products
    return (p.join(cats, p["category_id"] == cats["c_id"], "left")
            .select(*[p[c] for c in p.columns], "category_name"))


def list_products(t: Tables, store_id=None, category_id=None, search=None, min_price=None,
                  max_price=None, in_stock=None) -> DataFrame:
    """Products with their category name; every filter optional; by name."""
    p = flt.where(t.products, flt.eq_if("store_id", store_id), flt.eq_if("category_id", category_id),
                  flt.search_any(["name", "description"], search),
                  None if min_price is None else F.col("price") >= F.lit(min_price).cast("decimal(10,2)"),
                  None if max_price is None else F.col("price") <= F.lit(max_price).cast("decimal(10,2)"),
                  flt.stock_flag("quantity", in_stock))
    return _products_with_category(t, p).orderBy("store_id", "name", "id")


def product_detail(t: Tables, keys: DataFrame) -> DataFrame:
    """Products for a set of ``(store_id, id)`` keys; unknown keys give no row."""
    p = t.products.join(keys.select("store_id", "id"), ["store_id", "id"], "left_semi")
    return _products_with_category(t, p)


def list_reviews(t: Tables, product_keys: DataFrame | None = None) -> DataFrame:
    """Reviews with the reviewer's name, newest first.

    Inner join to users, so reviews whose user was removed (NULL) drop. Only
    reviews of existing products (optionally of the given ``(store_id, id)``
    keys) are listed, as the endpoint first checks the product.
    """
    prods = t.products.select("store_id", "id")
    if product_keys is not None:
        prods = prods.join(product_keys.select("store_id", "id"), ["store_id", "id"], "left_semi")
    r = t.product_reviews.join(prods.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    u = t.users.select("user_id", F.col("name").alias("user_name"))
    return (r.join(u, "user_id").select(*[r[c] for c in r.columns], "user_name")
            .orderBy(F.col("created_at").desc_nulls_first(), "id"))


# ---- orders: listings ------------------------------------------------------

def _line_totals(lines: DataFrame, key: str, heads: DataFrame | None = None) -> DataFrame:
    """Sums per order; with ``heads`` only of their lines, which are dropped before the shuffle of the sums."""
    if heads is not None:
        lines = lines.join(heads.select(F.col("id").alias(key)), key, "left_semi")
    return lines.groupBy(key).agg(sum_money(line_total()).alias("line_total"),
                                  F.count("id").cast("bigint").alias("line_count"))


def list_sales(t: Tables, store_id=None, customer_id=None, start=None, end=None,
               payment_method=None) -> DataFrame:
    """Sale headers with customer (left), user (inner) and the order total.

    Lines are summed per sale *before* the join, so the header join sees one
    row per sale; sales without lines total 0. A filter on the headers reaches
    the lines as a semi-join.
    """
    s = flt.where(t.sales, flt.eq_if("store_id", store_id), flt.eq_if("customer_id", customer_id),
                  flt.ts_range("created_at", start, end), flt.eq_if("payment_method", payment_method))
    c = t.customers.select(F.col("id").alias("c_id"), F.col("name").alias("customer_name"),
                           F.col("email").alias("customer_email"))
    filtered = any(x is not None for x in (store_id, customer_id, start, end, payment_method))
    tot = _line_totals(t.sale_items, "sale_id", s if filtered else None)
    u = _users(t)
    out = (s.join(c, s["customer_id"] == c["c_id"], "left")
           .join(u, s["user_id"] == u["u_id"], "inner")
           .join(tot, s["id"] == tot["sale_id"], "left"))
    return (out.select(*[s[x] for x in s.columns], "customer_name", "customer_email", *_user_cols(),
                       F.coalesce("line_total", F.lit(0).cast("decimal(38,2)")).alias("total_amount"))
            .orderBy(F.col("created_at").desc_nulls_first(), "id"))


def list_purchases(t: Tables, store_id=None, supplier_id=None, start=None, end=None) -> DataFrame:
    """Purchase headers with supplier (inner), user (inner) and the total."""
    p = flt.where(t.purchases, flt.eq_if("store_id", store_id), flt.eq_if("supplier_id", supplier_id),
                  flt.ts_range("created_at", start, end))
    sup = t.suppliers.select(F.col("id").alias("s_id"), F.col("name").alias("supplier_name"),
                             F.col("email").alias("supplier_email"))
    filtered = any(x is not None for x in (store_id, supplier_id, start, end))
    tot = _line_totals(t.purchase_items, "purchase_id", p if filtered else None)
    u = _users(t)
    out = (p.join(sup, p["supplier_id"] == sup["s_id"], "inner")
           .join(u, p["user_id"] == u["u_id"], "inner")
           .join(tot, p["id"] == tot["purchase_id"], "left"))
    return (out.select(*[p[x] for x in p.columns], "supplier_name", "supplier_email", *_user_cols(),
                       F.coalesce("line_total", F.lit(0).cast("decimal(38,2)")).alias("total_amount"))
            .orderBy(F.col("created_at").desc_nulls_first(), "id"))


def _items_detail(lines: DataFrame, heads: DataFrame, key: str, t: Tables) -> DataFrame:
    """Lines with product name/sku/barcode, only products of the order's store."""
    h = heads.select(F.col("id").alias(key), "store_id")
    p = t.products.select(F.col("id").alias("product_id"), F.col("store_id").alias("p_store"),
                          F.col("name").alias("product_name"), "sku", "barcode")
    out = lines.join(h, key).join(p, "product_id").filter(F.col("p_store") == F.col("store_id"))
    return out.select(*[lines[c] for c in lines.columns], "store_id", "product_name", "sku", "barcode")


def sale_items_detail(t: Tables, sale_keys: DataFrame | None = None) -> DataFrame:
    """Sale lines with product details; ``sale_keys`` = ``(store_id, id)`` of sales."""
    heads = t.sales if sale_keys is None else t.sales.join(
        sale_keys.select("store_id", "id"), ["store_id", "id"], "left_semi")
    return _items_detail(t.sale_items, heads, "sale_id", t)


def purchase_items_detail(t: Tables, purchase_keys: DataFrame | None = None) -> DataFrame:
    heads = t.purchases if purchase_keys is None else t.purchases.join(
        purchase_keys.select("store_id", "id"), ["store_id", "id"], "left_semi")
    return _items_detail(t.purchase_items, heads, "purchase_id", t)


# ---- suppliers ---------------------------------------------------------------

def list_suppliers(t: Tables, store_id=None, search=None, page_no: int = 1, limit: int = 10,
                   near_rows: int = NEAR_ROWS) -> DataFrame:
    """Suppliers matching ``search`` (name, contact, email), by name, one page per store.

    Pages beyond ``near_rows`` rows are found by rank (:mod:`~stockroom.functions.pages`).
    """
    s = flt.where(t.suppliers, flt.eq_if("store_id", store_id),
                  flt.search_any(["name", "contact_info", "email"], search))
    order = [F.col("name").asc_nulls_last(), F.col("id")]
    if store_id is None:
        return page_of_each(s, ["store_id"], order, ["name", "id"], page_no, limit, near_rows)
    if page_no * limit <= near_rows:
        return flt.page(s, order, page_no, limit)
    return page_of_each(s, [], order, ["name", "id"], page_no, limit, near_rows).orderBy(*order)


def supplier_page_info(t: Tables, store_id=None, page_no: int = 1, limit: int = 10) -> DataFrame:
    """Paging envelope per store: total (all suppliers: the search is not applied,
    as in the source), page, limit, pages = ceil(total / limit)."""
    page_no, limit = flt.check_paging(page_no, limit)
    s = flt.where(t.suppliers, flt.eq_if("store_id", store_id))
    totals = s.groupBy("store_id").agg(count_rows().alias("_n"))
    stores = flt.where(t.store.select(F.col("id").alias("store_id")), flt.eq_if("store_id", store_id))
    return (stores.join(totals, "store_id", "left")  # a store without suppliers has 0 of them on 0 pages
            .withColumn("total", F.coalesce("_n", F.lit(0).cast("bigint")))
            .select("store_id", "total", F.lit(int(page_no)).alias("page"), F.lit(int(limit)).alias("limit"),
                    F.ceil(F.col("total") / F.lit(int(limit))).cast("bigint").alias("pages")))


def supplier_detail(t: Tables, keys: DataFrame) -> DataFrame:
    return t.suppliers.join(keys.select("store_id", "id"), ["store_id", "id"], "left_semi")


def supplier_purchases(t: Tables, start=None, end=None, page_no: int = 1, limit: int = 10,
                       supplier_keys: DataFrame | None = None, near_rows: int = NEAR_ROWS) -> DataFrame:
    """Each supplier's purchases (store-scoped) with total and line count, newest first, paged."""
    p = flt.where(t.purchases, flt.ts_range("created_at", start, end))
    if supplier_keys is not None:
        k = supplier_keys.select("store_id", F.col("id").alias("supplier_id"))
        p = p.join(k, ["store_id", "supplier_id"], "left_semi")
    # the page first: only its purchases' lines are summed
    p = page_of_each(p, ["store_id", "supplier_id"], [F.col("created_at").desc_nulls_first(), F.col("id")],
                     ["created_at", "id"], page_no, limit, near_rows)
    tot = _line_totals(t.purchase_items, "purchase_id", p)
    return p.join(tot, p["id"] == tot["purchase_id"], "left").select(
        *[p[c] for c in p.columns],
        F.coalesce("line_total", F.lit(0).cast("decimal(38,2)")).alias("total_amount"),
        F.coalesce("line_count", F.lit(0).cast("bigint")).alias("total_items"))


def supplier_purchases_count(t: Tables, start=None, end=None, page_no: int = 1,
                             limit: int = 10) -> DataFrame:
    """Paging envelope per (store, supplier): distinct purchases with the same dates, 0 where there are none.

    One row for every supplier, in its own store.
    """
    page_no, limit = flt.check_paging(page_no, limit)
    p = flt.where(t.purchases, flt.ts_range("created_at", start, end))
    n = p.groupBy("store_id", "supplier_id").agg(F.countDistinct("id").cast("bigint").alias("_n"))
    s = t.suppliers.select("store_id", F.col("id").alias("supplier_id"))
    return (s.join(n, ["store_id", "supplier_id"], "left")
            .withColumn("total", F.coalesce("_n", F.lit(0).cast("bigint")))
            .select("store_id", "supplier_id", "total", F.lit(int(page_no)).alias("page"),
                    F.lit(int(limit)).alias("limit"),
                    F.ceil(F.col("total") / F.lit(int(limit))).cast("bigint").alias("pages")))


# ---- categories, stores, members ---------------------------------------------

def list_categories(t: Tables, store_id=None) -> DataFrame:
    return flt.where(t.categories, flt.eq_if("store_id", store_id))


def category_detail(t: Tables, keys: DataFrame) -> DataFrame:
    return t.categories.join(keys.select("store_id", "id"), ["store_id", "id"], "left_semi")


def user_stores(t: Tables, user_id=None) -> DataFrame:
    """Stores of each user with the role held there."""
    us = flt.where(t.user_store, flt.eq_if("user_id", user_id))
    s = t.store
    return (s.join(us, s["id"] == us["store_id"])
            .select(us["user_id"].alias("member_id"), *[s[c] for c in s.columns], us["role"]))


def store_detail(t: Tables, pairs: DataFrame) -> DataFrame:
    """Store columns plus the caller's role, for ``(user_id, store_id)`` pairs.

    Pairs without a membership get no row (the source answers 'Access denied').
    """
    us = t.user_store.join(pairs.select("user_id", "store_id"), ["user_id", "store_id"], "left_semi")
    s = t.store
    return (s.join(us, s["id"] == us["store_id"])
            .select(us["user_id"].alias("member_id"), *[s[c] for c in s.columns], us["role"]))


def store_users(t: Tables, store_id=None) -> DataFrame:
    """Members of each store with their role."""
    us = flt.where(t.user_store, flt.eq_if("store_id", store_id))
    return us.join(t.users, "user_id").select("store_id", "user_id", "name", "email", "role")


def list_transactions(ledger: DataFrame, store_id=None, product_id=None) -> DataFrame:
    """Ledger entries of a store (or of one product), newest first, ties by change id."""
    out = flt.where(ledger, flt.eq_if("store_id", store_id), flt.eq_if("product_id", product_id))
    return out.orderBy(F.col("created_at").desc_nulls_first(), F.col("change_id").desc_nulls_last())

