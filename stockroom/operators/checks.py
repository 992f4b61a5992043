"""Data checks with quarantine.

Each check returns its input rows plus ``errors: array<string>``;
:func:`split_valid` turns that into (good, quarantined) frames. Rules and
messages are the source's request validators and column constraints. All
checks are projections or joins -- no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import validation as V

# Validator messages of the source.
MSG = {
    "product_name": "Product name is required",
    "barcode": "Barcode is required",
    "quantity": "Quantity must be a non-negative integer",
    "unit_price": "Unit price must be a non-negative number",
    "rating": "Rating must be between 1 and 5",
    "review_text": "Review text is required",
    "store_name": "Store name is required",
    "location": "Location is required",
    "name": "Name is required",
    "email": "Valid email is required",
}


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, quarantined rows with their errors)."""
    ok = checked.filter(F.size("errors") == 0).drop("errors")
    bad = checked.filter(F.size("errors") > 0)
    return ok, bad


def check_products(raw: DataFrame) -> DataFrame:
    """name and barcode non-blank; quantity an integer >= 0; price a number >= 0."""
    return raw.withColumn("errors", V.errors([
        (V.blank(F.col("name")), MSG["product_name"]),
        (V.blank(F.col("barcode")), MSG["barcode"]),
        (V.not_int_at_least(F.col("quantity"), 0), MSG["quantity"]),
        (V.not_float_at_least(F.col("price"), 0.0), MSG["unit_price"]),
    ]))


def check_reviews(raw: DataFrame) -> DataFrame:
    """rating an integer 1..5; review text non-blank."""
    return raw.withColumn("errors", V.errors([
        (V.not_int_at_least(F.col("rating"), 1, 5), MSG["rating"]),
        (V.blank(F.col("review_text")), MSG["review_text"]),
    ]))


def check_stores(stores: DataFrame) -> DataFrame:
    return stores.withColumn("errors", V.errors([
        (V.blank(F.col("name")), MSG["store_name"]),
        (V.blank(F.col("location")), MSG["location"]),
    ]))


def check_users(users: DataFrame) -> DataFrame:
    return users.withColumn("errors", V.errors([
        (V.blank(F.col("name")), MSG["name"]),
        (V.not_email(F.col("email")), MSG["email"]),
    ]))


# Declared column limits of the source schema.
#   table: [(column, max length, NOT NULL)]
LENGTH_LIMITS = {
    "sales": [("payment_method", 50, False), ("payment_status", 50, False)],
    "products": [("status", 20, False)],
    "categories": [("name", 100, True)],
}


def check_lengths(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows breaking a VARCHAR(n) / NOT NULL limit: (table, id, errors)."""
    out = None
    for name, limits in LENGTH_LIMITS.items():
        df = tables[name]
        errs = V.errors([(V.too_long(F.col(c), n, req), f"{c} exceeds {n} characters or is missing"
                          if req else f"{c} exceeds {n} characters") for c, n, req in limits])
        part = (df.select(F.lit(name).alias("table"), F.col("id").cast("bigint").alias("id"), errs.alias("errors"))
                .filter(F.size("errors") > 0))
        out = part if out is None else out.unionByName(part)
    return out


def check_barcode_unique(products: DataFrame) -> DataFrame:
    """Products whose (trimmed) barcode occurs more than once in their store.

    Counted per (store, barcode) with map-side partial counts, then joined
    back, so a large duplicate group is never gathered into one row.
    """
    p = products.select("store_id", F.col("id").alias("product_id"), F.trim("barcode").alias("barcode"))
    dup = (p.groupBy("store_id", "barcode").agg(F.count(F.lit(1)).cast("bigint").alias("occurrences"))
           .filter(F.col("occurrences") > 1))
    return p.join(dup, ["store_id", "barcode"]).select("store_id", "barcode", "product_id", "occurrences")


def check_references(t) -> DataFrame:
    """Orphan keys: product->category, review->product, review->user, category->store."""
    cats = t.categories.select(F.col("id").alias("k"))
    prods = t.products.select(F.col("id").alias("k"))
    users = t.users.select(F.col("user_id").alias("k"))
    stores = t.store.select(F.col("id").alias("k"))

    def orphans(df, rel, key, ref):
        d = df.filter(F.col(key).isNotNull()).select(F.col("id").cast("bigint").alias("id"),
                                                      F.col(key).cast("bigint").alias("k"))
        return d.join(ref, "k", "left_anti").select(F.lit(rel).alias("relation"), "id",
                                                     F.col("k").alias("missing_key"))

    return (orphans(t.products, "product.category_id", "category_id", cats)
            .unionByName(orphans(t.product_reviews, "review.product_id", "product_id", prods))
            .unionByName(orphans(t.product_reviews, "review.user_id", "user_id", users))
            .unionByName(orphans(t.categories, "category.store_id", "store_id", stores)))


def check_store_isolation(t) -> DataFrame:
    """Rows that cross a tenant boundary.

    Order lines whose product belongs to another store than the order, and
    sales/purchases whose customer/supplier belongs to another store.
    Output: (kind, order_id, row_id, store_id, other_store_id).
    """
    prod = t.products.select(F.col("id").alias("product_id"), F.col("store_id").alias("other_store_id"))

    def lines(items, heads, key, kind):
        h = heads.select(F.col("id").alias(key), "store_id")
        return (items.join(h, key).join(prod, "product_id")
                .filter(F.col("other_store_id") != F.col("store_id"))
                .select(F.lit(kind).alias("kind"), F.col(key).alias("order_id"), F.col("id").alias("row_id"),
                        "store_id", "other_store_id"))

    def party(heads, pkey, parties, kind):
        pt = parties.select(F.col("id").alias(pkey), F.col("store_id").alias("other_store_id"))
        return (heads.join(pt, pkey).filter(F.col("other_store_id") != F.col("store_id"))
                .select(F.lit(kind).alias("kind"), F.col("id").alias("order_id"), F.col(pkey).alias("row_id"),
                        "store_id", "other_store_id"))

    return (lines(t.sale_items, t.sales, "sale_id", "sale_line_product")
            .unionByName(lines(t.purchase_items, t.purchases, "purchase_id", "purchase_line_product"))
            .unionByName(party(t.sales, "customer_id", t.customers, "sale_customer"))
            .unionByName(party(t.purchases, "supplier_id", t.suppliers, "purchase_supplier")))
