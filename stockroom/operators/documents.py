"""Order documents: a header row with its lines nested as an array.

The source builds these with ``json_agg(json_build_object(...))`` (order
unspecified); here the lines become ``array<struct>`` sorted by line id, so
documents are deterministic. Lines are grouped per order *before* the header
join, so the header join sees one row per order. ``to_json`` is applied only
at the sink (:func:`stockroom.sources.sinks.export_json`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import line_total, money
from ..sources.tables import Tables


def _nested_lines(lines: DataFrame, key: str, t: Tables) -> DataFrame:
    """Per order: ``items`` = lines (inner-joined to products) sorted by id."""
    p = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    item = F.struct(F.col("id"), F.col("product_id"), F.col("product_name"), F.col("quantity"),
                    F.col("unit_price"), money(line_total()).alias("total"))
    return (lines.join(p, "product_id")
            .groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items")))


def sale_documents(t: Tables, with_user: bool = True, sale_keys: DataFrame | None = None) -> DataFrame:
    """Sale header + customer (left) + user (inner, if ``with_user``) + nested lines.

    Sales without lines produce no document (inner join to lines), as in the
    source. ``with_user=False`` is the shape returned after an update.
    """
    s = t.sales
    if sale_keys is not None:
        s = s.join(sale_keys.select("store_id", "id"), ["store_id", "id"], "left_semi")
    lines = t.sale_items
    if sale_keys is not None:  # only the wanted sales' lines are nested
        lines = lines.join(s.select(F.col("id").alias("sale_id")), "sale_id", "left_semi")
    docs = _nested_lines(lines, "sale_id", t)
    c = t.customers.select(F.col("id").alias("c_id"), F.col("name").alias("customer_name"),
                           F.col("email").alias("customer_email"))
    out = s.join(c, s["customer_id"] == c["c_id"], "left")
    extra = []
    if with_user:
        u = t.users.select(F.col("user_id").alias("u_id"), F.col("name").alias("user_name"),
                           F.col("email").alias("user_email"))
        out = out.join(u, s["user_id"] == u["u_id"], "inner")
        extra = ["user_name", "user_email"]
    out = out.join(docs, s["id"] == docs["sale_id"], "inner")
    return out.select(*[s[x] for x in s.columns], "customer_name", "customer_email", *extra, "items")


def purchase_documents(t: Tables, with_user: bool = True,
                       purchase_keys: DataFrame | None = None) -> DataFrame:
    """Purchase header + supplier (inner) + user (inner, if asked) + nested lines."""
    p = t.purchases
    if purchase_keys is not None:
        p = p.join(purchase_keys.select("store_id", "id"), ["store_id", "id"], "left_semi")
    lines = t.purchase_items
    if purchase_keys is not None:
        lines = lines.join(p.select(F.col("id").alias("purchase_id")), "purchase_id", "left_semi")
    docs = _nested_lines(lines, "purchase_id", t)
    sup = t.suppliers.select(F.col("id").alias("s_id"), F.col("name").alias("supplier_name"),
                             F.col("email").alias("supplier_email"))
    out = p.join(sup, p["supplier_id"] == sup["s_id"], "inner")
    extra = []
    if with_user:
        u = t.users.select(F.col("user_id").alias("u_id"), F.col("name").alias("user_name"),
                           F.col("email").alias("user_email"))
        out = out.join(u, p["user_id"] == u["u_id"], "inner")
        extra = ["user_name", "user_email"]
    out = out.join(docs, p["id"] == docs["purchase_id"], "inner")
    return out.select(*[p[x] for x in p.columns], "supplier_name", "supplier_email", *extra, "items")
