"""Registered data-check queries (§2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from .registry import register

register("check_products")(lambda t: C.check_products(t.products_raw))
register("quarantine_products")(lambda t: C.split_valid(C.check_products(t.products_raw))[1])
register("check_reviews")(lambda t: C.check_reviews(t.reviews_raw))
register("check_stores")(lambda t: C.check_stores(
    t.store_creates.select(F.col("new_id").alias("id"), "name", "location")))
register("check_users")(lambda t: C.check_users(t.users))
register("check_lengths")(lambda t: C.check_lengths(
    {"sales": t.sales, "products": t.products, "categories": t.category_inserts}))
register("check_barcode_unique")(lambda t: C.check_barcode_unique(t.products_raw))
register("check_references")(lambda t: C.check_references(t.replace(
    products=t.dangling_products, product_reviews=t.dangling_reviews, categories=t.dangling_categories)))
register("check_store_isolation")(lambda t: C.check_store_isolation(t))
