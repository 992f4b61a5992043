"""DuckDB oracle text for the catalogue write paths."""

from __future__ import annotations

from .catalog_plans import AS_OF
from .oracle import oracle

TS = f"TIMESTAMP '{AS_OF}'"


def _guard(roles: tuple[str, ...]) -> str:
    inlist = ", ".join(f"'{r}'" for r in roles)
    return (f"CASE WHEN g.role IS NULL THEN 'Access denied' WHEN g.role NOT IN ({inlist}) "
            f"THEN 'Insufficient permissions' END")


_G = "LEFT JOIN {user_store} g ON g.user_id = r.user_id AND g.store_id = r.store_id"

# -- products
_INS = ("x", f"""
SELECT r.*, coalesce({_guard(('admin', 'manager'))},
  CASE WHEN r.category_id IS NOT NULL AND NOT EXISTS (
       SELECT 1 FROM {{categories}} c WHERE c.id = r.category_id AND c.store_id = r.store_id)
       THEN 'Invalid Category' END) AS reason
FROM {{product_inserts}} r {_G}
""")
oracle("insert_products", f"""
SELECT new_id AS id, store_id, category_id, name, description, sku, barcode, cast(NULL as varchar) AS unit,
       cast(NULL as varchar) AS image_url, 'active' AS status, price, quantity,
       cast(NULL as int) AS min_stock_level, cast(NULL as int) AS max_stock_level,
       {TS} AS updated_at, cast(NULL as timestamp) AS last_updated_at
FROM {{x}} WHERE reason IS NULL
""", [_INS])
oracle("insert_products_rejects", "SELECT store_id, new_id, reason FROM {x} WHERE reason IS NOT NULL", [_INS])

_PATCH = ("x", f"""
SELECT r.request_id, r.store_id, r.id, r.price AS new_price, r.description AS new_description,
       r.category_id AS new_category_id,
       coalesce({_guard(('admin', 'manager'))},
         CASE WHEN p.id IS NULL THEN 'Product not found'
              WHEN r.category_id IS NOT NULL AND NOT EXISTS (
                 SELECT 1 FROM {{categories}} c WHERE c.id = r.category_id AND c.store_id = r.store_id)
              THEN 'Invalid Category' END) AS reason
FROM {{product_patches}} r {_G} LEFT JOIN {{products}} p ON p.id = r.id AND p.store_id = r.store_id
""")
_PATCHED = ("y", """
SELECT store_id, id, arg_max(new_price, request_id) FILTER (new_price IS NOT NULL) AS new_price,
       arg_max(new_description, request_id) FILTER (new_description IS NOT NULL) AS new_description,
       arg_max(new_category_id, request_id) FILTER (new_category_id IS NOT NULL) AS new_category_id
FROM {x} WHERE reason IS NULL GROUP BY store_id, id
""")
oracle("patch_products", f"""
SELECT p.id, p.store_id, coalesce(y.new_category_id, p.category_id) AS category_id, p.name,
       coalesce(y.new_description, p.description) AS description, p.sku, p.barcode, p.unit, p.image_url, p.status,
       coalesce(y.new_price, p.price) AS price, p.quantity, p.min_stock_level, p.max_stock_level,
       {TS} AS updated_at, p.last_updated_at
FROM {{y}} y JOIN {{products}} p ON p.id = y.id AND p.store_id = y.store_id
""", [_PATCH, _PATCHED])
oracle("patch_products_rejects", "SELECT store_id, id, reason FROM {x} WHERE reason IS NOT NULL", [_PATCH])


def _deletes(requests: str, table: str, roles: tuple[str, ...], message: str) -> tuple[str, str]:
    """Requests with their reason; the second delete of a row finds nothing."""
    return ("x", f"""
SELECT store_id, id, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY store_id, id, reason IS NULL ORDER BY user_id) > 1
                          THEN '{message}' ELSE reason END AS reason
FROM (SELECT r.*, coalesce({_guard(roles)}, CASE WHEN p.id IS NULL THEN '{message}' END) AS reason
      FROM {{{requests}}} r {_G} LEFT JOIN {{{table}}} p ON p.id = r.id AND p.store_id = r.store_id) q
""")


_DP = _deletes("product_deletes", "products", ("admin",), "Product not found")
oracle("delete_products", """
SELECT p.* FROM {products} p
WHERE NOT EXISTS (SELECT 1 FROM {x} d WHERE d.id = p.id AND d.store_id = p.store_id AND d.reason IS NULL)
""", [_DP])
oracle("delete_products_reviews", """
SELECT r.* FROM {product_reviews} r
WHERE r.product_id IS NULL OR r.product_id NOT IN (SELECT id FROM {x} WHERE reason IS NULL)
""", [_DP])
oracle("delete_products_rejects", "SELECT * FROM {x} WHERE reason IS NOT NULL", [_DP])

_REV = ("x", f"""
SELECT r.*, coalesce({_guard(('admin', 'manager', 'staff'))},
  CASE WHEN NOT EXISTS (SELECT 1 FROM {{products}} p WHERE p.id = r.product_id AND p.store_id = r.store_id)
       THEN 'Product not found'
       WHEN r.rating NOT BETWEEN 1 AND 5 THEN 'Rating must be between 1 and 5' END) AS reason
FROM {{review_requests}} r {_G}
""")
oracle("add_reviews", f"""
SELECT (SELECT max(id) FROM {{product_reviews}}) + row_number() OVER (ORDER BY request_id) AS id,
       product_id, user_id, rating, review_text, {TS} AS created_at, {TS} AS updated_at
FROM {{x}} WHERE reason IS NULL
""", [_REV])
oracle("add_reviews_rejects", "SELECT request_id, reason FROM {x} WHERE reason IS NOT NULL", [_REV])

oracle("null_review_users", """
SELECT r.id, r.product_id, CASE WHEN r.user_id IN (SELECT user_id FROM {user_removals}) THEN NULL
                                ELSE r.user_id END AS user_id,
       r.rating, r.review_text, r.created_at, r.updated_at
FROM {product_reviews} r
""")

# -- suppliers
_LEDGER = ("cast(NULL as bigint) AS change_id, cast(store_id as bigint) AS store_id, cast(NULL as bigint) AS product_id, "
           "'supplier_{a}' AS type, cast(NULL as int) AS quantity, cast(NULL as decimal(10,2)) AS unit_price, "
           "cast(user_id as bigint) AS created_by, cast(NULL as bigint) AS reference_id, "
           "'Supplier ' || {n} || ' {a}' AS notes, " + TS + " AS created_at")

_REG = ("x", f"""
SELECT r.*, coalesce({_guard(('admin', 'manager'))},
  CASE WHEN EXISTS (SELECT 1 FROM {{suppliers}} s WHERE s.store_id = r.store_id AND lower(s.name) = lower(r.name))
       THEN 'A supplier with this name already exists'
       WHEN r.request_id <> (SELECT min(r2.request_id) FROM {{supplier_requests}} r2
                             JOIN {{user_store}} g2 ON g2.user_id = r2.user_id AND g2.store_id = r2.store_id
                             WHERE g2.role IN ('admin', 'manager')
                               AND r2.store_id = r.store_id AND lower(r2.name) = lower(r.name))
       THEN 'A supplier with this name already exists' END) AS reason
FROM {{supplier_requests}} r {_G}
""")
oracle("register_suppliers", f"""
SELECT (SELECT max(id) FROM {{suppliers}}) + row_number() OVER (ORDER BY request_id) AS id,
       store_id, name, contact_info, email, cast(NULL as varchar) AS phone,
       cast(NULL as varchar) AS address, {TS} AS created_at, {TS} AS updated_at
FROM {{x}} WHERE reason IS NULL
""", [_REG])
oracle("register_suppliers_ledger", "SELECT " + _LEDGER.format(a="created", n="name") + " FROM {x} WHERE reason IS NULL",
       [_REG])
oracle("register_suppliers_rejects", "SELECT request_id, reason FROM {x} WHERE reason IS NOT NULL", [_REG])

_PS0 = ("x0", f"""
SELECT r.request_id, r.store_id, r.id, r.user_id, r.name AS new_name, r.phone AS new_phone,
       coalesce({_guard(('admin', 'manager'))},
         CASE WHEN s.id IS NULL THEN 'Supplier not found'
              WHEN r.name IS NOT NULL AND EXISTS (SELECT 1 FROM {{suppliers}} o WHERE o.store_id = r.store_id
                   AND lower(o.name) = lower(r.name) AND o.id <> r.id)
              THEN 'A supplier with this name already exists' END) AS reason
FROM {{supplier_patches}} r {_G} LEFT JOIN {{suppliers}} s ON s.id = r.id AND s.store_id = r.store_id
""")
_PS = ("x", """
SELECT * REPLACE (CASE WHEN reason IS NULL AND new_name IS NOT NULL AND id <> first_value(id) OVER (
                         PARTITION BY store_id, lower(new_name), reason IS NULL ORDER BY request_id, id)
                       THEN 'A supplier with this name already exists' ELSE reason END AS reason) FROM {x0}
""")
_PSY = ("y", """
SELECT store_id, id, arg_max(new_name, request_id) FILTER (new_name IS NOT NULL) AS new_name,
       arg_max(new_phone, request_id) FILTER (new_phone IS NOT NULL) AS new_phone
FROM {x} WHERE reason IS NULL GROUP BY store_id, id
""")
oracle("patch_suppliers", f"""
SELECT s.id, s.store_id, coalesce(y.new_name, s.name) AS name, s.contact_info, s.email,
       coalesce(y.new_phone, s.phone) AS phone, s.address, s.created_at, {TS} AS updated_at
FROM {{y}} y JOIN {{suppliers}} s ON s.id = y.id AND s.store_id = y.store_id
""", [_PS0, _PS, _PSY])
oracle("patch_suppliers_ledger", "SELECT " + _LEDGER.format(a="updated", n="s.name").replace(
    "cast(store_id", "cast(x.store_id").replace("cast(user_id", "cast(x.user_id")
    + " FROM {x} x JOIN {suppliers} s ON s.id = x.id AND s.store_id = x.store_id WHERE x.reason IS NULL", [_PS0, _PS])
oracle("patch_suppliers_rejects", "SELECT store_id, id, reason FROM {x} WHERE reason IS NOT NULL", [_PS0, _PS])

_DS0 = ("x0", f"""
SELECT r.store_id, r.id, r.user_id, s.name,
       coalesce({_guard(('admin', 'manager'))},
         CASE WHEN s.id IS NULL THEN 'Supplier not found'
              WHEN EXISTS (SELECT 1 FROM {{purchases}} p WHERE p.supplier_id = r.id AND p.store_id = r.store_id)
              THEN 'Cannot delete supplier with existing purchases' END) AS reason
FROM {{supplier_deletes}} r {_G} LEFT JOIN {{suppliers}} s ON s.id = r.id AND s.store_id = r.store_id
""")
_DS = ("x", """
SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY store_id, id, reason IS NULL ORDER BY user_id) > 1
                       THEN 'Supplier not found' ELSE reason END AS reason) FROM {x0}
""")
oracle("delete_suppliers", """
SELECT s.* FROM {suppliers} s
WHERE NOT EXISTS (SELECT 1 FROM {x} x WHERE x.id = s.id AND x.store_id = s.store_id AND x.reason IS NULL)
""", [_DS0, _DS])
oracle("delete_suppliers_ledger", "SELECT " + _LEDGER.format(a="deleted", n="name") + " FROM {x} WHERE reason IS NULL",
       [_DS0, _DS])
oracle("delete_suppliers_rejects", "SELECT store_id, id, reason FROM {x} WHERE reason IS NOT NULL", [_DS0, _DS])

# -- categories
_CI = ("x", f"""
SELECT r.*, coalesce({_guard(('admin', 'manager'))},
         CASE WHEN r.name IS NULL THEN 'Category name is required'
              WHEN length(r.name) > 100 THEN 'Category name is too long' END) AS reason
FROM {{category_inserts}} r {_G}
""")
oracle("insert_categories", f"""
SELECT id, store_id, name, description, {TS} AS created_at FROM {{x}} WHERE reason IS NULL
""", [_CI])
oracle("insert_categories_rejects", "SELECT store_id, id, reason FROM {x} WHERE reason IS NOT NULL", [_CI])

_CU = ("x", f"""
SELECT r.*, c.created_at, coalesce({_guard(('admin', 'manager'))},
         CASE WHEN c.id IS NULL THEN 'Category not found' WHEN r.name IS NULL THEN 'Category name is required'
              WHEN length(r.name) > 100 THEN 'Category name is too long' END) AS reason
FROM {{category_updates}} r {_G} LEFT JOIN {{categories}} c ON c.id = r.id AND c.store_id = r.store_id
""")
oracle("update_categories", """
SELECT id, store_id, name, description, created_at FROM {x} WHERE reason IS NULL
QUALIFY row_number() OVER (PARTITION BY store_id, id ORDER BY request_id DESC) = 1
""", [_CU])
oracle("update_categories_rejects", "SELECT store_id, id, reason FROM {x} WHERE reason IS NOT NULL", [_CU])

_CD = _deletes("category_deletes", "categories", ("admin", "manager"), "Category not found")
oracle("delete_categories", """
SELECT c.* FROM {categories} c
WHERE NOT EXISTS (SELECT 1 FROM {x} d WHERE d.id = c.id AND d.store_id = c.store_id AND d.reason IS NULL)
""", [_CD])
oracle("delete_categories_products", """
SELECT p.* REPLACE (CASE WHEN p.category_id IN (SELECT id FROM {x} WHERE reason IS NULL)
                         THEN NULL ELSE p.category_id END AS category_id)
FROM {products} p
""", [_CD])
oracle("delete_categories_rejects", "SELECT * FROM {x} WHERE reason IS NOT NULL", [_CD])

# -- stores
oracle("create_stores", f"""
SELECT new_id AS id, name, location, owner_name, user_id, cast(NULL as varchar) AS logo_url, {TS} AS updated_at
FROM {{store_creates}}
""")
oracle("create_stores_members", "SELECT user_id, new_id AS store_id, 'admin' AS role FROM {store_creates}")

_SA = ("a", """
SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM {user_store} g WHERE g.user_id = r.user_id AND g.store_id = r.id
                                  AND g.role = 'admin') THEN 'Access denied'
                 WHEN r.id NOT IN (SELECT id FROM {store}) THEN 'Store not found' END AS reason
FROM {store_updates} r
""")
oracle("update_stores", f"""
SELECT s.id, x.name, x.location, x.owner_name, s.user_id, s.logo_url, {TS} AS updated_at
FROM {{store}} s JOIN (SELECT * FROM {{a}} WHERE reason IS NULL
                       QUALIFY row_number() OVER (PARTITION BY id ORDER BY request_id DESC, user_id DESC) = 1) x ON s.id = x.id
""", [_SA])
oracle("update_stores_rejects", "SELECT user_id, id, reason FROM {a} WHERE reason IS NOT NULL", [_SA])

_SD = ("a", """
SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM {user_store} g WHERE g.user_id = r.user_id AND g.store_id = r.id
                                  AND g.role = 'admin') THEN 'Access denied'
                 WHEN r.id NOT IN (SELECT id FROM {store}) THEN 'Store not found' END AS reason
FROM {store_deletes} r
""")
_SD2 = ("b", """
SELECT a.*, min(CASE WHEN reason IS NULL THEN user_id END) OVER (PARTITION BY id) AS first_user FROM {a} a
""")
oracle("delete_stores", "SELECT s.* FROM {store} s WHERE s.id NOT IN (SELECT id FROM {a} WHERE reason IS NULL)",
       [_SD])
oracle("delete_stores_categories", """
SELECT c.* FROM {categories} c WHERE c.store_id NOT IN (SELECT id FROM {a} WHERE reason IS NULL)
""", [_SD])
oracle("delete_stores_products", """
SELECT p.* REPLACE (CASE WHEN p.category_id IN (
         SELECT c.id FROM {categories} c WHERE c.store_id IN (SELECT id FROM {a} WHERE reason IS NULL))
       THEN NULL ELSE p.category_id END AS category_id)
FROM {products} p
""", [_SD])
oracle("delete_stores_rejects", """
SELECT user_id, id, coalesce(reason, 'Store not found') AS reason FROM {b}
WHERE reason IS NOT NULL OR user_id <> first_user
""", [_SD, _SD2])

oracle("evolve_schema", """
SELECT o_orderkey AS id, cast(NULL as bigint) AS store_id, cast(NULL as bigint) AS customer_id,
       cast(NULL as bigint) AS user_id, cast(NULL as varchar) AS payment_method, 'pending' AS payment_status,
       cast(0 as decimal(10,2)) AS discount, cast(0 as decimal(10,2)) AS tax, cast(NULL as varchar) AS notes,
       o_orderdate AS created_at, cast(NULL as timestamp) AS updated_at, cast(NULL as timestamp) AS last_updated_at
FROM orders
""")
