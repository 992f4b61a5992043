"""DuckDB oracle text for access and membership queries."""

from __future__ import annotations

from .oracle import oracle

_ALLOWED = """CASE r.action WHEN 'create_sale' THEN us.role IN ('admin', 'manager', 'cashier') WHEN 'list_sales' THEN us.role IS NOT NULL WHEN 'get_sale' THEN us.role IS NOT NULL WHEN 'get_sale_items' THEN us.role IS NOT NULL WHEN 'sales_report' THEN us.role IS NOT NULL WHEN 'update_sale' THEN us.role IN ('admin', 'manager') WHEN 'delete_sale' THEN us.role IN ('admin', 'manager') WHEN 'create_purchase' THEN us.role IN ('admin', 'manager') WHEN 'list_purchases' THEN us.role IS NOT NULL WHEN 'get_purchase' THEN us.role IS NOT NULL WHEN 'get_purchase_items' THEN us.role IS NOT NULL WHEN 'update_purchase' THEN us.role IN ('admin', 'manager') WHEN 'delete_purchase' THEN us.role IN ('admin', 'manager') WHEN 'list_products' THEN us.role IN ('admin', 'manager', 'staff') WHEN 'get_product' THEN us.role IN ('admin', 'manager', 'staff') WHEN 'create_product' THEN us.role IN ('admin', 'manager') WHEN 'update_product' THEN us.role IN ('admin', 'manager') WHEN 'delete_product' THEN us.role IN ('admin') WHEN 'add_review' THEN us.role IN ('admin', 'manager', 'staff') WHEN 'list_reviews' THEN us.role IN ('admin', 'manager', 'staff') WHEN 'create_supplier' THEN us.role IN ('admin', 'manager') WHEN 'list_suppliers' THEN us.role IS NOT NULL WHEN 'get_supplier' THEN us.role IS NOT NULL WHEN 'update_supplier' THEN us.role IN ('admin', 'manager') WHEN 'delete_supplier' THEN us.role IN ('admin', 'manager') WHEN 'supplier_purchases' THEN us.role IS NOT NULL WHEN 'create_category' THEN us.role IN ('admin', 'manager') WHEN 'list_categories' THEN us.role IS NOT NULL WHEN 'get_category' THEN us.role IS NOT NULL WHEN 'update_category' THEN us.role IN ('admin', 'manager') WHEN 'delete_category' THEN us.role IN ('admin', 'manager') WHEN 'get_store' THEN us.role IN ('admin', 'manager', 'staff') WHEN 'update_store' THEN us.role IN ('admin') WHEN 'delete_store' THEN us.role IN ('admin') END"""

oracle("authorize_requests", f"""
SELECT r.*, us.role,
       CASE WHEN us.role IS NULL THEN 'Access denied'
            WHEN ({_ALLOWED}) IS NULL THEN 'Unknown action'
            WHEN NOT ({_ALLOWED}) THEN 'Insufficient permissions' END AS reason,
       (us.role IS NOT NULL AND coalesce({_ALLOWED}, false)) AS allowed
FROM {{action_requests}} r LEFT JOIN {{user_store}} us ON r.user_id = us.user_id AND r.store_id = us.store_id
""")

oracle("list_suppliers_for_callers", """
SELECT q.user_id AS caller_id, s.* FROM {store_pairs} q
JOIN {user_store} g ON g.user_id = q.user_id AND g.store_id = q.store_id JOIN {suppliers} s ON s.store_id = q.store_id
""")
oracle("list_products_for_callers", """
SELECT q.user_id AS caller_id, p.* FROM {store_pairs} q
JOIN {user_store} g ON g.user_id = q.user_id AND g.store_id = q.store_id AND g.role IN ('admin', 'manager', 'staff')
JOIN {products} p ON p.store_id = q.store_id
""")
oracle("list_products_denied", """
SELECT q.user_id, q.store_id, CASE WHEN g.role IS NULL THEN 'Access denied' ELSE 'Insufficient permissions' END AS reason
FROM {store_pairs} q LEFT JOIN {user_store} g ON g.user_id = q.user_id AND g.store_id = q.store_id
WHERE g.role IS NULL OR g.role NOT IN ('admin', 'manager', 'staff')
""")

_MEMBERSHIP = """
SELECT r.user_id, r.store_id, r.role,
       CASE WHEN u.user_id IS NULL THEN 'User does not exist'
            WHEN s.id IS NULL THEN 'Store does not exist'
            WHEN r.role NOT IN ('admin', 'manager', 'staff') THEN 'Invalid role' END AS reason
FROM {membership_requests} r LEFT JOIN {users} u ON r.user_id = u.user_id LEFT JOIN {store} s ON r.store_id = s.id
"""
oracle("accept_user_requests", "SELECT user_id, store_id, role FROM {m} WHERE reason IS NULL", [("m", _MEMBERSHIP)])
oracle("accept_user_rejects", "SELECT * FROM {m} WHERE reason IS NOT NULL", [("m", _MEMBERSHIP)])

_ROLE = """
SELECT r.request_id, r.user_id, r.store_id, r.role,
       CASE WHEN us.user_id IS NULL THEN 'User is not associated with this store'
            WHEN r.role NOT IN ('admin', 'manager', 'staff') THEN 'Invalid role' END AS reason
FROM {role_updates} r LEFT JOIN {user_store} us ON r.user_id = us.user_id AND r.store_id = us.store_id
"""
oracle("update_user_roles", """
SELECT us.user_id, us.store_id, coalesce(v.role, us.role) AS role
FROM {user_store} us LEFT JOIN (
  SELECT user_id, store_id, arg_max(role, request_id) AS role FROM {r} WHERE reason IS NULL GROUP BY user_id, store_id
) v ON us.user_id = v.user_id AND us.store_id = v.store_id
""", [("r", _ROLE)])
oracle("update_user_role_rejects", "SELECT * FROM {r} WHERE reason IS NOT NULL", [("r", _ROLE)])

_IMPORT = """
SELECT i.*, (i.email IN (SELECT email FROM {users})) AS known,
       i.request_id = min(i.request_id) OVER (PARTITION BY i.email) AS first
FROM {user_imports} i
"""
oracle("import_users", """
SELECT (SELECT max(user_id) FROM {users}) + row_number() OVER (ORDER BY request_id) AS user_id, name, email
FROM {i} WHERE NOT known AND first
""", [("i", _IMPORT)])
oracle("import_user_rejects", """
SELECT request_id, name, email, 'User already exists' AS reason FROM {i} WHERE known OR NOT first
""", [("i", _IMPORT)])
