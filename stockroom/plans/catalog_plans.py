"""Registered catalogue write-path queries (§2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as K
from ..sources.schemas import evolve_schema
from .registry import register

AS_OF = "2024-06-30 00:00:00"  # NOW() of the batch


def _reg(name, fn, parts):
    for suffix, attr in parts:
        register(name + suffix)((lambda a: (lambda t: getattr(fn(t), a)))(attr))


_reg("insert_products", lambda t: K.insert_products(t.product_inserts, t, t.user_store, AS_OF),
     [("", "rows"), ("_rejects", "rejects")])
_reg("patch_products", lambda t: K.patch_products(t.product_patches, t, t.user_store, AS_OF),
     [("", "rows"), ("_rejects", "rejects")])
_reg("delete_products", lambda t: K.delete_products(t.product_deletes, t, t.user_store),
     [("", "rows"), ("_reviews", "extra"), ("_rejects", "rejects")])
_reg("add_reviews", lambda t: K.add_reviews(t.review_requests, t, t.user_store, AS_OF),
     [("", "rows"), ("_rejects", "rejects")])
register("null_review_users")(lambda t: K.null_review_users(t.user_removals, t.product_reviews))
_reg("register_suppliers", lambda t: K.register_suppliers(t.supplier_requests, t, t.user_store, AS_OF),
     [("", "rows"), ("_ledger", "ledger"), ("_rejects", "rejects")])
_reg("patch_suppliers", lambda t: K.patch_suppliers(t.supplier_patches, t, t.user_store, AS_OF),
     [("", "rows"), ("_ledger", "ledger"), ("_rejects", "rejects")])
_reg("delete_suppliers", lambda t: K.delete_suppliers(t.supplier_deletes, t, t.user_store, AS_OF),
     [("", "rows"), ("_ledger", "ledger"), ("_rejects", "rejects")])
_reg("insert_categories", lambda t: K.insert_categories(t.category_inserts, t.user_store, AS_OF),
     [("", "rows"), ("_rejects", "rejects")])
_reg("update_categories", lambda t: K.update_categories(t.category_updates, t, t.user_store),
     [("", "rows"), ("_rejects", "rejects")])
_reg("delete_categories", lambda t: K.delete_categories(t.category_deletes, t, t.user_store),
     [("", "rows"), ("_products", "extra"), ("_rejects", "rejects")])
_reg("create_stores", lambda t: K.create_stores(t.store_creates, AS_OF), [("", "rows"), ("_members", "extra")])
_reg("update_stores", lambda t: K.update_stores(t.store_updates, t, AS_OF), [("", "rows"), ("_rejects", "rejects")])
_reg("delete_stores", lambda t: K.delete_stores(t.store_deletes, t),
     [("", "rows"), ("_categories", "extra"), ("_products", "products"), ("_rejects", "rejects")])
register("evolve_schema")(lambda t: evolve_schema(
    t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")), "sales"))
