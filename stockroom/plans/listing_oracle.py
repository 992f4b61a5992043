"""DuckDB oracle text for the listing, detail and document queries."""

from __future__ import annotations

from .listing_plans import (LATE_LIMIT, LATE_PAGE, MAX_PRICE, MIN_PRICE, PAST_PAGE, PAYMENT_METHOD, PRODUCT_SEARCH,
                            SP_LIMIT, SP_PAGE, SP_START, SUPPLIER_LIMIT, SUPPLIER_PAGE, SUPPLIER_SEARCH, WILDCARD_SEARCH)
from .oracle import MONEY, ORACLE, oracle
from .registry import RANGE_END, RANGE_START

_PRODUCTS = """
SELECT p.*, c.name AS category_name
FROM {products} p LEFT JOIN {categories} c ON p.category_id = c.id
WHERE 1 = 1 """

oracle("list_products", _PRODUCTS + f"""
  AND (p.name ILIKE '%{PRODUCT_SEARCH}%' OR p.description ILIKE '%{PRODUCT_SEARCH}%')
  AND p.price >= {MIN_PRICE} AND p.price <= {MAX_PRICE} AND p.quantity > 0
""")
oracle("list_products_all", _PRODUCTS)
oracle("list_products_out_of_stock", _PRODUCTS + f"""
  AND (p.name ILIKE '%{WILDCARD_SEARCH}%' OR p.description ILIKE '%{WILDCARD_SEARCH}%')
  AND p.quantity = 0
""")
oracle("list_products_category", _PRODUCTS + " AND p.store_id = 3 AND p.category_id = 313")

oracle("product_detail", """
SELECT p.*, c.name AS category_name
FROM {products} p LEFT JOIN {categories} c ON p.category_id = c.id
WHERE EXISTS (SELECT 1 FROM {product_keys} k WHERE k.store_id = p.store_id AND k.id = p.id)
""")

oracle("list_reviews", """
SELECT pr.*, u.name AS user_name
FROM {product_reviews} pr JOIN {users} u ON pr.user_id = u.user_id
WHERE pr.product_id IN (SELECT id FROM {products})
""")

_SALES = f"""
SELECT s.*, c.name AS customer_name, c.email AS customer_email, u.name AS user_name, u.email AS user_email,
       cast(coalesce(sum(si.quantity * si.unit_price), 0) as {MONEY}) AS total_amount
FROM {{sales}} s LEFT JOIN {{customers}} c ON s.customer_id = c.id
JOIN {{users}} u ON s.user_id = u.user_id
LEFT JOIN {{sale_items}} si ON s.id = si.sale_id
WHERE 1 = 1 {{cond}}
GROUP BY ALL
"""
oracle("list_sales", _SALES.replace("{cond}", f"""
  AND s.created_at >= TIMESTAMP '{RANGE_START} 00:00:00' AND s.created_at <= TIMESTAMP '{RANGE_END} 00:00:00'
  AND s.payment_method = '{PAYMENT_METHOD}'"""))
oracle("list_sales_all", _SALES.replace("{cond}", ""))

_SALE_DOCS = ("docs", f"""
SELECT si.sale_id, list(struct_pack(id := si.id, product_id := si.product_id, product_name := p.name,
                                    quantity := si.quantity, unit_price := si.unit_price,
                                    total := cast(si.quantity * si.unit_price as {MONEY})) ORDER BY si.id) AS items
FROM {{sale_items}} si JOIN {{products}} p ON si.product_id = p.id
GROUP BY si.sale_id
""")
oracle("sale_documents", """
SELECT s.*, c.name AS customer_name, c.email AS customer_email, u.name AS user_name, u.email AS user_email,
       d.items
FROM {sales} s LEFT JOIN {customers} c ON s.customer_id = c.id
JOIN {users} u ON s.user_id = u.user_id JOIN {docs} d ON s.id = d.sale_id
""", [_SALE_DOCS])
oracle("export_json", ORACLE["sale_documents"])
oracle("json_documents", ORACLE["sale_documents"])
oracle("sale_documents_after_update", """
SELECT s.*, c.name AS customer_name, c.email AS customer_email, d.items
FROM {sales} s LEFT JOIN {customers} c ON s.customer_id = c.id JOIN {docs} d ON s.id = d.sale_id
""", [_SALE_DOCS])

oracle("sale_items_detail", """
SELECT si.*, s.store_id, p.name AS product_name, p.sku, p.barcode
FROM {sale_items} si JOIN {sales} s ON si.sale_id = s.id JOIN {products} p ON si.product_id = p.id
WHERE p.store_id = s.store_id
""")

_PURCHASES = f"""
SELECT p.*, s.name AS supplier_name, s.email AS supplier_email, u.name AS user_name, u.email AS user_email,
       cast(coalesce(sum(pi.quantity * pi.unit_price), 0) as {MONEY}) AS total_amount
FROM {{purchases}} p JOIN {{suppliers}} s ON p.supplier_id = s.id
JOIN {{users}} u ON p.user_id = u.user_id
LEFT JOIN {{purchase_items}} pi ON p.id = pi.purchase_id
WHERE 1 = 1 {{cond}}
GROUP BY ALL
"""
oracle("list_purchases", _PURCHASES.replace("{cond}", f"""
  AND p.created_at >= TIMESTAMP '{RANGE_START} 00:00:00' AND p.created_at <= TIMESTAMP '{RANGE_END} 00:00:00'"""))
oracle("list_purchases_all", _PURCHASES.replace("{cond}", ""))

_PURCHASE_DOCS = ("docs", f"""
SELECT pi.purchase_id, list(struct_pack(id := pi.id, product_id := pi.product_id, product_name := pr.name,
                                        quantity := pi.quantity, unit_price := pi.unit_price,
                                        total := cast(pi.quantity * pi.unit_price as {MONEY})) ORDER BY pi.id) AS items
FROM {{purchase_items}} pi JOIN {{products}} pr ON pi.product_id = pr.id
GROUP BY pi.purchase_id
""")
oracle("purchase_documents", """
SELECT p.*, s.name AS supplier_name, s.email AS supplier_email, u.name AS user_name, u.email AS user_email,
       d.items
FROM {purchases} p JOIN {suppliers} s ON p.supplier_id = s.id
JOIN {users} u ON p.user_id = u.user_id JOIN {docs} d ON p.id = d.purchase_id
""", [_PURCHASE_DOCS])
oracle("purchase_documents_after_update", """
SELECT p.*, s.name AS supplier_name, s.email AS supplier_email, d.items
FROM {purchases} p JOIN {suppliers} s ON p.supplier_id = s.id JOIN {docs} d ON p.id = d.purchase_id
""", [_PURCHASE_DOCS])

oracle("purchase_items_detail", """
SELECT pi.*, pu.store_id, p.name AS product_name, p.sku, p.barcode
FROM {purchase_items} pi JOIN {purchases} pu ON pi.purchase_id = pu.id JOIN {products} p ON pi.product_id = p.id
WHERE p.store_id = pu.store_id
""")

_lo, _hi = (SUPPLIER_PAGE - 1) * SUPPLIER_LIMIT, SUPPLIER_PAGE * SUPPLIER_LIMIT
oracle("list_suppliers", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.store_id ORDER BY s.name, s.id) AS rn
  FROM {{suppliers}} s
  WHERE s.name ILIKE '%{SUPPLIER_SEARCH}%' OR s.contact_info ILIKE '%{SUPPLIER_SEARCH}%'
        OR s.email ILIKE '%{SUPPLIER_SEARCH}%'
) x WHERE rn > {_lo} AND rn <= {_hi}
""")
oracle("list_suppliers_store", """
SELECT * FROM {suppliers} WHERE store_id = 3 ORDER BY name, id LIMIT 10 OFFSET 0
""")
oracle("supplier_page_info", f"""
SELECT st.id AS store_id, cast(count(s.id) as bigint) AS total, {SUPPLIER_PAGE} AS page, {SUPPLIER_LIMIT} AS "limit",
       cast(ceil(count(s.id) / {SUPPLIER_LIMIT}) as bigint) AS pages
FROM {{store}} st LEFT JOIN {{suppliers}} s ON s.store_id = st.id GROUP BY st.id
""")
oracle("supplier_detail", """
SELECT s.* FROM {suppliers} s
WHERE EXISTS (SELECT 1 FROM {supplier_keys} k WHERE k.store_id = s.store_id AND k.id = s.id)
""")

_SUPPLIER_PURCHASES = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT x.*, row_number() OVER (PARTITION BY x.store_id, x.supplier_id ORDER BY x.created_at DESC, x.id) AS rn
  FROM (
    SELECT p.*, cast(coalesce(sum(pi.quantity * pi.unit_price), 0) as {MONEY}) AS total_amount,
           cast(count(pi.id) as bigint) AS total_items
    FROM {{purchases}} p LEFT JOIN {{purchase_items}} pi ON p.id = pi.purchase_id
    WHERE p.created_at >= TIMESTAMP '{SP_START} 00:00:00'
    GROUP BY ALL
  ) x
) y WHERE rn """
oracle("supplier_purchases", f"{_SUPPLIER_PURCHASES} BETWEEN {(SP_PAGE - 1) * SP_LIMIT + 1} AND {SP_PAGE * SP_LIMIT}")
_late = f"BETWEEN {(LATE_PAGE - 1) * LATE_LIMIT + 1} AND {LATE_PAGE * LATE_LIMIT}"
oracle("supplier_purchases_late_page", f"{_SUPPLIER_PURCHASES} {_late}")
oracle("list_suppliers_late_page", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.store_id ORDER BY s.name, s.id) AS rn FROM {{suppliers}} s
) x WHERE rn {_late}
""")
oracle("list_suppliers_store_late_page", f"""
SELECT * FROM {{suppliers}} WHERE store_id = 3 ORDER BY name, id LIMIT {SUPPLIER_LIMIT} OFFSET {(SUPPLIER_PAGE - 1) * SUPPLIER_LIMIT}
""")


def _purchases_count(page: int, limit: int, more: str = "") -> str:
    return f"""
SELECT s.store_id, s.id AS supplier_id, cast(count(DISTINCT p.id) as bigint) AS total, {page} AS page,
       {limit} AS "limit", cast(ceil(count(DISTINCT p.id) / {limit}) as bigint) AS pages{more}
FROM {{suppliers}} s LEFT JOIN {{purchases}} p ON p.supplier_id = s.id AND p.store_id = s.store_id
  AND p.created_at >= TIMESTAMP '{SP_START} 00:00:00'
GROUP BY s.store_id, s.id
"""


oracle("supplier_purchases_count", _purchases_count(SP_PAGE, SP_LIMIT))
# ranks begin after all purchases of a supplier
oracle("supplier_purchases_past_end", _purchases_count(
    PAST_PAGE, LATE_LIMIT, f", cast(greatest(0, least({LATE_LIMIT}, count(DISTINCT p.id) - {(PAST_PAGE - 1) * LATE_LIMIT})) "
    "as bigint) AS rows_on_page"))

oracle("list_categories", "SELECT * FROM {categories}")
oracle("category_detail", """
SELECT c.* FROM {categories} c
WHERE EXISTS (SELECT 1 FROM {category_keys} k WHERE k.store_id = c.store_id AND k.id = c.id)
""")
oracle("user_stores", """
SELECT us.user_id AS member_id, s.*, us.role FROM {store} s JOIN {user_store} us ON s.id = us.store_id
""")
oracle("store_detail", """
SELECT us.user_id AS member_id, s.*, us.role FROM {store} s JOIN {user_store} us ON s.id = us.store_id
WHERE EXISTS (SELECT 1 FROM {store_pairs} q WHERE q.user_id = us.user_id AND q.store_id = us.store_id)
""")
oracle("store_users", """
SELECT us.store_id, us.user_id, u.name, u.email, us.role FROM {user_store} us JOIN {users} u ON us.user_id = u.user_id
""")
