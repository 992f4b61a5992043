"""Batch write paths for the catalogue: products, reviews, suppliers,
categories, stores and users.

A write endpoint handles one request; each operator here takes a frame of
requests plus the current tables and returns an :class:`Outcome`: the new
or changed rows (or the new snapshot), ledger rows where the source writes
them, and rejects with the reason of the first failing test, in the order
the handler tests. No table is updated in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import largest, number_rows
from ..sources.schemas import evolve_schema
from ..sources.tables import Tables
from .access import split_authorized
from .ledger import _ledger_select


@dataclass
class Outcome:
    rows: DataFrame
    rejects: DataFrame
    ledger: DataFrame | None = None
    extra: DataFrame | None = None
    keys: DataFrame | None = None   # (request_id, id) of accepted requests whose id was given here


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The message of the first failing check (NULL when all pass)."""
    out = None
    for cond, msg in checks:
        c = F.coalesce(cond, F.lit(False))
        out = F.when(c, F.lit(msg)) if out is None else out.when(c, F.lit(msg))
    return out


def _split(df: DataFrame, reason: Column, key_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    d = df.withColumn("reason", reason)
    return (d.filter(F.col("reason").isNull()).drop("reason"),
            d.filter(F.col("reason").isNotNull()).select(*key_cols, "reason"))


def _guard(requests: DataFrame, user_store: DataFrame | None, action: str, key_cols: list[str]):
    if user_store is None:
        return requests, None
    ok, bad = split_authorized(requests, user_store, action)
    return ok, bad.select(*key_cols, "reason")


def _union(*frames: DataFrame | None) -> DataFrame:
    fs = [f for f in frames if f is not None]
    out = fs[0]
    for f in fs[1:]:
        out = out.unionByName(f)
    return out


def _flag(df: DataFrame, keys: dict[str, str], name: str) -> DataFrame:
    """``df``'s key columns renamed to the request's names, plus a TRUE flag."""
    return df.select(*[F.col(src).alias(dst) for src, dst in keys.items()]).distinct().withColumn(name, F.lit(True))


def _merged(valid: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key of several patches: per column the last value given, in ``request_id`` order.

    A value's order is (request_id, value), so patches without a
    ``request_id`` still merge the same way each time. Partial aggregates
    only: many patches of one key are combined before the shuffle.
    """
    order = F.col("request_id") if "request_id" in valid.columns else F.lit(0)
    return valid.groupBy(*keys).agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v")))).getField("v").alias(c)
        for c in columns])


def _first_of(valid: DataFrame, keys: list[str], message: str) -> tuple[DataFrame, DataFrame]:
    """Of several deletes of one key the one with the least user id applies; the others get ``message``."""
    user = F.min("user_id") if "user_id" in valid.columns else F.lit(None).cast("bigint")
    once = valid.groupBy(*keys).agg(user.alias("user_id"), F.count(F.lit(1)).alias("_n"))
    late = (once.filter("_n > 1").withColumn("_k", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_n"))))
            .select(*keys, F.lit(message).alias("reason")))
    return once.drop("_n"), late


def _ts(as_of) -> Column:
    return F.lit(None).cast("timestamp_ntz") if as_of is None else F.lit(str(as_of)).cast("timestamp_ntz")


# ---- products ------------------------------------------------------------------

def insert_products(req: DataFrame, t: Tables, user_store: DataFrame | None = None, as_of=None) -> Outcome:
    """New products; a given category must belong to the store ('Invalid Category')."""
    keys = ["store_id", "new_id"]
    req, denied = _guard(req, user_store, "create_product", keys)
    cats = _flag(t.categories, {"id": "category_id", "store_id": "store_id"}, "_cat")
    j = req.join(cats, ["category_id", "store_id"], "left")
    ok, bad = _split(j, first_reason((F.col("category_id").isNotNull() & F.col("_cat").isNull(),
                                      "Invalid Category")), keys)
    rows = evolve_schema(ok.withColumn("id", F.col("new_id")).withColumn("updated_at", _ts(as_of)), "products")
    return Outcome(rows, _union(denied, bad))


_PRODUCT_PATCH = ["name", "description", "price", "quantity", "category_id", "sku", "barcode", "unit",
                  "min_stock_level", "max_stock_level"]


def patch_products(req: DataFrame, t: Tables, user_store: DataFrame | None = None, as_of=None) -> Outcome:
    """COALESCE patch of ten columns. Unknown product, or a category of another store, rejects.

    Several accepted patches of a product apply in ``request_id`` order.
    """
    keys = ["store_id", "id"]
    req, denied = _guard(req, user_store, "update_product", keys)
    for c in _PRODUCT_PATCH:
        if c not in req.columns:
            req = req.withColumn(c, F.lit(None))
    order = ["request_id"] if "request_id" in req.columns else []
    r = req.select("store_id", "id", *order, *[F.col(c).alias("new_" + c) for c in _PRODUCT_PATCH])
    p = t.products
    j = r.join(p.select(*keys).withColumn("_p", F.lit(True)), keys, "left")
    cats = _flag(t.categories, {"id": "new_category_id", "store_id": "store_id"}, "_cat")
    j = j.join(cats, ["new_category_id", "store_id"], "left")
    ok, bad = _split(j, first_reason((F.col("_p").isNull(), "Product not found"),
                                     (F.col("new_category_id").isNotNull() & F.col("_cat").isNull(),
                                      "Invalid Category")), keys)
    ok = p.join(_merged(ok, keys, ["new_" + c for c in _PRODUCT_PATCH]), keys)
    patched = ok.select(*[F.coalesce(F.col("new_" + c).cast(p.schema[c].dataType), F.col(c)).alias(c)
                          if c in _PRODUCT_PATCH else F.col(c) for c in p.columns if c != "updated_at"],
                        _ts(as_of).alias("updated_at"))
    return Outcome(evolve_schema(patched, "products"), _union(denied, bad))


def delete_products(req: DataFrame, t: Tables, user_store: DataFrame | None = None) -> Outcome:
    """Delete products; unknown -> 'Product not found', also for a second delete; their reviews go too (cascade).

    ``rows`` = remaining products, ``extra`` = remaining reviews.
    """
    keys = ["store_id", "id"]
    req, denied = _guard(req, user_store, "delete_product", keys)
    known = req.join(t.products.select(*keys), keys, "left_semi")
    bad = req.join(t.products.select(*keys), keys, "left_anti").select(*keys, F.lit("Product not found").alias("reason"))
    gone, late = _first_of(known, keys, "Product not found")
    gone, bad = gone.select(*keys), bad.unionByName(late)
    remaining = t.products.join(gone, keys, "left_anti")
    reviews = t.product_reviews.join(gone.select(F.col("id").alias("product_id")), "product_id", "left_anti")
    return Outcome(remaining, _union(denied, bad), extra=reviews)


def add_reviews(req: DataFrame, t: Tables, user_store: DataFrame | None = None, as_of=None) -> Outcome:
    """New reviews: product must be in the store; rating 1..5 (the column check).

    Ids are given above the table's largest, in ``request_id`` order; ``keys``
    has (request_id, id).
    """
    keys = ["request_id"]
    req, denied = _guard(req, user_store, "add_review", keys)
    prods = _flag(t.products, {"id": "product_id", "store_id": "store_id"}, "_p")
    j = req.join(prods, ["product_id", "store_id"], "left")
    ok, bad = _split(j, first_reason((F.col("_p").isNull(), "Product not found"),
                                     (~F.col("rating").between(1, 5), "Rating must be between 1 and 5")), keys)
    ok = number_rows(ok, ["request_id"], "id", largest(t.product_reviews))
    rows = evolve_schema(ok.withColumn("created_at", _ts(as_of)).withColumn("updated_at", _ts(as_of)), "product_reviews")
    return Outcome(rows, _union(denied, bad), keys=ok.select("request_id", "id"))


def null_review_users(removed_users: DataFrame, reviews: DataFrame) -> DataFrame:
    """Removed users' reviews stay, with ``user_id`` set to NULL (ON DELETE SET NULL)."""
    gone = removed_users.select("user_id").distinct().withColumn("_gone", F.lit(True))
    j = reviews.join(gone, "user_id", "left")
    return j.select(*[F.when(F.col("_gone"), F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias(c)
                      if c == "user_id" else F.col(c) for c in reviews.columns])


# ---- suppliers -------------------------------------------------------------------

def _supplier_ledger(df: DataFrame, action: str, name_col: str, as_of) -> DataFrame:
    return _ledger_select(df, change_id=F.lit(None), store_id=F.col("store_id"), product_id=F.lit(None),
                          type=F.lit(f"supplier_{action}"), quantity=F.lit(None), unit_price=F.lit(None),
                          created_by=F.col("user_id"), reference_id=F.lit(None),
                          notes=F.concat(F.lit("Supplier "), F.col(name_col), F.lit(f" {action}")),
                          created_at=_ts(as_of))


DUPLICATE_SUPPLIER = "A supplier with this name already exists"


def register_suppliers(req: DataFrame, t: Tables, user_store: DataFrame | None = None, as_of=None) -> Outcome:
    """New suppliers unless lower(name) exists in the store; in a batch the first request wins.

    Only requests the guard lets through count as first. Ids are given above
    the table's largest, in ``request_id`` order. Ledger: 'supplier_created'.
    """
    keys = ["request_id"]
    req, denied = _guard(req, user_store, "create_supplier", keys)
    r = req.withColumn("_lname", F.lower("name"))
    existing = _flag(t.suppliers.withColumn("_lname", F.lower("name")),
                     {"store_id": "store_id", "_lname": "_lname"}, "_dup")
    first = r.groupBy("store_id", "_lname").agg(F.min("request_id").alias("_first"))
    j = r.join(existing, ["store_id", "_lname"], "left").join(first, ["store_id", "_lname"], "left")
    ok, bad = _split(j, first_reason((F.col("_dup"), DUPLICATE_SUPPLIER),
                                     (F.col("request_id") != F.col("_first"), DUPLICATE_SUPPLIER)), keys)
    ok = number_rows(ok, ["request_id"], "id", largest(t.suppliers))
    rows = evolve_schema(ok.withColumn("created_at", _ts(as_of)).withColumn("updated_at", _ts(as_of)), "suppliers")
    return Outcome(rows, _union(denied, bad), ledger=_supplier_ledger(ok, "created", "name", as_of),
                   keys=ok.select("request_id", "id"))


_SUPPLIER_PATCH = ["name", "contact_info", "email", "phone", "address"]


def patch_suppliers(req: DataFrame, t: Tables, user_store: DataFrame | None = None, as_of=None) -> Outcome:
    """COALESCE patch; unknown -> 'Supplier not found'; a name clash with another id
    in the store rejects. Ledger: 'supplier_updated' noting the *old* name.

    Several accepted patches of a supplier apply in ``request_id`` order. Of
    those that ask for one new name in a store the supplier of the first gets
    it. A name that a rename of this batch frees can be taken from the next
    batch on. Each accepted patch writes its ledger row.
    """
    keys = ["store_id", "id"]
    req, denied = _guard(req, user_store, "update_supplier", keys)
    for c in _SUPPLIER_PATCH:
        if c not in req.columns:
            req = req.withColumn(c, F.lit(None).cast("string"))
    if "request_id" not in req.columns:
        req = req.withColumn("request_id", F.lit(0).cast("bigint"))
    r = req.select("store_id", "id", "user_id", "request_id", *[F.col(c).alias("new_" + c) for c in _SUPPLIER_PATCH])
    s = t.suppliers
    j = r.join(s.withColumn("_s", F.lit(True)), keys, "left")
    # clash: another id in the store has the same lower(name). Counted per
    # (store, lower(name)) first, so a popular name never produces all pairs:
    # two or more holders always include another id; one holder clashes
    # unless it is the supplier itself.
    holders = (s.groupBy("store_id", F.lower("name").alias("_lname"))
               .agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_holder")))
    j = (j.withColumn("_lname", F.lower("new_name")).join(holders, ["store_id", "_lname"], "left")
         .withColumn("_clash", F.col("new_name").isNotNull()
                     & ((F.col("_n") > 1) | ((F.col("_n") == 1) & (F.col("_holder") != F.col("id"))))))
    ok, bad = _split(j, first_reason((F.col("_s").isNull(), "Supplier not found"),
                                     (F.col("_clash"), DUPLICATE_SUPPLIER)), keys)
    # the first claim of a new name, by (request_id, id), wins among the requests valid so far
    claims = (ok.filter(F.col("new_name").isNotNull()).groupBy("store_id", "_lname")
              .agg(F.min(F.struct("request_id", "id")).getField("id").alias("_winner")))
    ok, beaten = _split(ok.join(claims, ["store_id", "_lname"], "left"), first_reason(
        (F.col("new_name").isNotNull() & (F.col("_winner") != F.col("id")), DUPLICATE_SUPPLIER)), keys)
    bad = bad.unionByName(beaten)
    merged = s.join(_merged(ok, keys, ["new_" + c for c in _SUPPLIER_PATCH]), keys)
    patched = merged.select(*[F.coalesce(F.col("new_" + c), F.col(c)).alias(c) if c in _SUPPLIER_PATCH
                              else F.col(c) for c in s.columns if c != "updated_at"], _ts(as_of).alias("updated_at"))
    ledger = _supplier_ledger(ok, "updated", "name", as_of)
    return Outcome(evolve_schema(patched, "suppliers"), _union(denied, bad), ledger=ledger)


def delete_suppliers(req: DataFrame, t: Tables, user_store: DataFrame | None = None, as_of=None) -> Outcome:
    """Delete unless purchases exist; ``rows`` = remaining suppliers. Ledger: 'supplier_deleted'.

    Of several deletes of a supplier one applies; the others find none.
    """
    keys = ["store_id", "id"]
    req, denied = _guard(req, user_store, "delete_supplier", keys)
    s = t.suppliers.select("store_id", "id", "name").withColumn("_s", F.lit(True))
    used = _flag(t.purchases, {"store_id": "store_id", "supplier_id": "id"}, "_used")
    j = req.join(s, keys, "left").join(used, keys, "left")
    ok, bad = _split(j, first_reason((F.col("_s").isNull(), "Supplier not found"),
                                     (F.col("_used"), "Cannot delete supplier with existing purchases")), keys)
    ok, late = _first_of(ok, [*keys, "name"], "Supplier not found")
    bad = bad.unionByName(late.select(*keys, "reason"))
    remaining = t.suppliers.join(ok.select(*keys), keys, "left_anti")
    return Outcome(remaining, _union(denied, bad), ledger=_supplier_ledger(ok, "deleted", "name", as_of))


# ---- categories -------------------------------------------------------------------

def _category_name_checks() -> list[tuple[Column, str]]:
    return [(F.col("name").isNull(), "Category name is required"),
            (F.length("name") > 100, "Category name is too long")]


def insert_categories(req: DataFrame, user_store: DataFrame | None = None, as_of=None) -> Outcome:
    """New categories; name NOT NULL and at most 100 characters."""
    keys = ["store_id", "id"]
    req, denied = _guard(req, user_store, "create_category", keys)
    ok, bad = _split(req, first_reason(*_category_name_checks()), keys)
    return Outcome(evolve_schema(ok.withColumn("created_at", _ts(as_of)), "categories"), _union(denied, bad))


def update_categories(req: DataFrame, t: Tables, user_store: DataFrame | None = None) -> Outcome:
    """Overwrite name and description (a NULL description overwrites); unknown rejects.

    Of several accepted updates of a category the last by ``request_id`` stays.
    """
    keys = ["store_id", "id"]
    req, denied = _guard(req, user_store, "update_category", keys)
    c = t.categories
    if "request_id" not in req.columns:
        req = req.withColumn("request_id", F.lit(0).cast("bigint"))
    r = req.select("store_id", "id", "request_id", "name", "description")
    j = r.join(c.select("store_id", "id", "created_at").withColumn("_c", F.lit(True)), keys, "left")
    ok, bad = _split(j, first_reason((F.col("_c").isNull(), "Category not found"), *_category_name_checks()), keys)
    last = ok.groupBy(*keys, "created_at").agg(F.max(F.struct("request_id", "name", "description")).alias("_l"))
    ok = last.select(*keys, "created_at", "_l.name", "_l.description")
    return Outcome(evolve_schema(ok, "categories"), _union(denied, bad))


def delete_categories(req: DataFrame, t: Tables, user_store: DataFrame | None = None) -> Outcome:
    """Delete; products of a deleted category keep existing with ``category_id`` NULL.

    A second delete of a category finds none.

    ``rows`` = remaining categories, ``extra`` = products after the null-out.
    """
    keys = ["store_id", "id"]
    req, denied = _guard(req, user_store, "delete_category", keys)
    known, late = _first_of(req.join(t.categories.select(*keys), keys, "left_semi"), keys, "Category not found")
    known = known.select(*keys)
    bad = req.join(t.categories.select(*keys), keys, "left_anti").select(*keys, F.lit("Category not found").alias("reason"))
    bad = bad.unionByName(late)
    remaining = t.categories.join(known, keys, "left_anti")
    return Outcome(remaining, _union(denied, bad), extra=_without_categories(t.products, known))


def _without_categories(products: DataFrame, gone: DataFrame) -> DataFrame:
    """``products`` with ``category_id`` NULL where that category is ``gone`` (ON DELETE SET NULL)."""
    gone = gone.select(F.col("id").alias("category_id")).distinct().withColumn("_gone", F.lit(True))
    p = products.join(gone, "category_id", "left")
    return p.select(*[F.when(F.col("_gone"), F.lit(None).cast("bigint")).otherwise(F.col(c)).alias(c)
                      if c == "category_id" else F.col(c) for c in products.columns])


# ---- stores -----------------------------------------------------------------------

def create_stores(req: DataFrame, as_of=None) -> Outcome:
    """New stores (id = ``new_id``) and an 'admin' membership for each creator (``extra``)."""
    stores = evolve_schema(req.withColumn("id", F.col("new_id")).withColumn("updated_at", _ts(as_of)), "store")
    members = req.select("user_id", F.col("new_id").alias("store_id"), F.lit("admin").alias("role"))
    # creating a store has no failure mode of its own: no rejects
    none = req.sparkSession.createDataFrame([], "id bigint, reason string")
    return Outcome(stores, none, extra=members)


def _admin_requests(req: DataFrame, t: Tables) -> tuple[DataFrame, DataFrame]:
    """Requests by an admin of an existing store, and the rest with their reason."""
    keys = ["user_id", "id"]
    admin = (t.user_store.filter(F.col("role") == "admin")
             .select("user_id", F.col("store_id").alias("id")).distinct().withColumn("_admin", F.lit(True)))
    known = t.store.select("id").withColumn("_st", F.lit(True))
    j = req.join(admin, keys, "left").join(known, "id", "left")
    return _split(j, first_reason((F.col("_admin").isNull(), "Access denied"),
                                  (F.col("_st").isNull(), "Store not found")), keys)


def update_stores(req: DataFrame, t: Tables, as_of=None) -> Outcome:
    """Overwrite name, location, owner_name; only an admin of the store may.

    Several admin requests for one store all succeed, applied in
    ``request_id`` order, so the last one's values stay.
    """
    if "request_id" not in req.columns:
        req = req.withColumn("request_id", F.lit(0).cast("bigint"))
    ok, bad = _admin_requests(req, t)
    last = ok.groupBy("id").agg(F.max(F.struct("request_id", "user_id", "name", "location", "owner_name")).alias("_l"))
    s = t.store
    new = last.select("id", F.col("_l.name").alias("n_name"), F.col("_l.location").alias("n_location"),
                      F.col("_l.owner_name").alias("n_owner"))
    out = s.join(new, "id").select(
        *[F.col({"name": "n_name", "location": "n_location", "owner_name": "n_owner"}.get(c, c)).alias(c)
          for c in s.columns if c != "updated_at"], _ts(as_of).alias("updated_at"))
    return Outcome(evolve_schema(out, "store"), bad)


def delete_stores(req: DataFrame, t: Tables) -> Outcome:
    """Delete stores (admin only); their categories go too (cascade).

    ``rows`` = remaining stores, ``extra`` = remaining categories, ``products``
    = the products, ``category_id`` NULL where the category went.
    """
    ok, bad = _admin_requests(req, t)
    # applied in user-id order: the first deletes, the later ones find no store
    per_user = ok.groupBy("id", "user_id").agg(F.count(F.lit(1)).alias("_n"))
    first = per_user.groupBy("id").agg(F.min("user_id").alias("_first"))
    late = per_user.join(first, "id").withColumn(
        "_n", F.col("_n") - (F.col("user_id") == F.col("_first")).cast("bigint")).filter("_n > 0")
    late = (late.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
            .select("user_id", "id", F.lit("Store not found").alias("reason")))
    bad = bad.unionByName(late)
    gone = first.select(F.col("id").alias("store_id"))
    remaining = t.store.join(gone.withColumnRenamed("store_id", "id"), "id", "left_anti")
    cats = t.categories.join(gone, "store_id", "left_anti")
    out = Outcome(remaining, bad, extra=cats)
    out.products = _without_categories(t.products, t.categories.join(gone, "store_id", "left_semi"))
    return out
