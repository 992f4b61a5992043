"""DuckDB oracle text for the data checks."""

from __future__ import annotations

from .oracle import oracle

_INT = "'^[-+]?(0|[1-9][0-9]*)$'"
_FLOAT = "'^[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)$'"
_EMAIL = "'^[^@\\s]+@[^@\\s]+[.][^@\\s]+$'"


def _blank(c):
    return f"({c} IS NULL OR length(trim({c})) = 0)"


def _not_int(c, lo, hi=None):
    v = f"try_cast(trim({c}) as bigint)"
    cond = f"{c} IS NULL OR NOT regexp_matches(trim({c}), {_INT}) OR {v} IS NULL OR {v} < {lo}"
    if hi is not None:
        cond += f" OR {v} > {hi}"
    return f"coalesce({cond}, true)"


def _not_float(c, lo):
    v = f"try_cast(trim({c}) as double)"
    return f"coalesce({c} IS NULL OR NOT regexp_matches(trim({c}), {_FLOAT}) OR {v} IS NULL OR {v} < {lo}, true)"


def _errors(rules):
    items = ", ".join(f"CASE WHEN {cond} THEN '{msg}' END" for cond, msg in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL) AS errors"


_PRODUCT_ERRORS = _errors([(_blank("r.name"), "Product name is required"),
                           (_blank("r.barcode"), "Barcode is required"),
                           (_not_int("r.quantity", 0), "Quantity must be a non-negative integer"),
                           (_not_float("r.price", 0), "Unit price must be a non-negative number")])
oracle("check_products", f"SELECT r.*, {_PRODUCT_ERRORS} FROM {{products_raw}} r")
oracle("quarantine_products", f"""
SELECT * FROM (SELECT r.*, {_PRODUCT_ERRORS} FROM {{products_raw}} r) x WHERE len(errors) > 0
""")
oracle("check_reviews", "SELECT r.*, " + _errors([
    (_not_int("r.rating", 1, 5), "Rating must be between 1 and 5"),
    (_blank("r.review_text"), "Review text is required")]) + " FROM {reviews_raw} r")
oracle("check_stores", "SELECT new_id AS id, name, location, " + _errors([
    (_blank("name"), "Store name is required"), (_blank("location"), "Location is required")])
    + " FROM {store_creates}")
oracle("check_users", "SELECT u.*, " + _errors([
    (_blank("u.name"), "Name is required"),
    (f"coalesce(u.email IS NULL OR NOT regexp_matches(u.email, {_EMAIL}), true)", "Valid email is required")])
    + " FROM {users} u")


def _len(table, rules):
    return (f"SELECT * FROM (SELECT '{table}' AS \"table\", cast(id as bigint) AS id, "
            + _errors(rules) + f" FROM {{{table}}}) x WHERE len(errors) > 0")


oracle("check_lengths", "\nUNION ALL\n".join([
    _len("sales", [("coalesce(length(payment_method) > 50, false)", "payment_method exceeds 50 characters"),
                   ("coalesce(length(payment_status) > 50, false)", "payment_status exceeds 50 characters")]),
    _len("products", [("coalesce(length(status) > 20, false)", "status exceeds 20 characters")]),
    _len("category_inserts", [("coalesce(name IS NULL OR length(name) > 100, false)",
                               "name exceeds 100 characters or is missing")]).replace(
        "'category_inserts' AS", "'categories' AS"),
]))

oracle("check_barcode_unique", """
SELECT p.store_id, trim(p.barcode) AS barcode, p.id AS product_id, d.occurrences
FROM {products_raw} p JOIN (SELECT store_id, trim(barcode) AS b, cast(count(*) as bigint) AS occurrences
                            FROM {products_raw} GROUP BY store_id, trim(barcode) HAVING count(*) > 1) d
  ON p.store_id = d.store_id AND trim(p.barcode) = d.b
""")

oracle("check_references", """
SELECT 'product.category_id' AS relation, id, category_id AS missing_key FROM {dangling_products}
WHERE category_id IS NOT NULL AND category_id NOT IN (SELECT id FROM {dangling_categories})
UNION ALL
SELECT 'review.product_id', id, product_id FROM {dangling_reviews}
WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM {dangling_products})
UNION ALL
SELECT 'review.user_id', id, user_id FROM {dangling_reviews}
WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM {users})
UNION ALL
SELECT 'category.store_id', id, store_id FROM {dangling_categories}
WHERE store_id IS NOT NULL AND store_id NOT IN (SELECT id FROM {store})
""")

oracle("check_store_isolation", """
SELECT 'sale_line_product' AS kind, si.sale_id AS order_id, si.id AS row_id, s.store_id, p.store_id AS other_store_id
FROM {sale_items} si JOIN {sales} s ON si.sale_id = s.id JOIN {products} p ON si.product_id = p.id
WHERE p.store_id <> s.store_id
UNION ALL
SELECT 'purchase_line_product', pi.purchase_id, pi.id, pu.store_id, p.store_id
FROM {purchase_items} pi JOIN {purchases} pu ON pi.purchase_id = pu.id JOIN {products} p ON pi.product_id = p.id
WHERE p.store_id <> pu.store_id
UNION ALL
SELECT 'sale_customer', s.id, s.customer_id, s.store_id, c.store_id
FROM {sales} s JOIN {customers} c ON s.customer_id = c.id WHERE c.store_id <> s.store_id
UNION ALL
SELECT 'purchase_supplier', pu.id, pu.supplier_id, pu.store_id, su.store_id
FROM {purchases} pu JOIN {suppliers} su ON pu.supplier_id = su.id WHERE su.store_id <> pu.store_id
""")
