"""Mapping of the driver's test tables onto the canonical tables.

This is stand-in input only: it gives rows in the canonical schema and does
none of any operator's work. The text is written so that the same SQL runs in
Spark SQL and in DuckDB; ``{name}`` marks a table reference (a raw test table
or an earlier canonical table) and ``{json_k}`` the one engine-specific
expression. The oracle renders the same text as CTEs, so both engines see the
same inputs by construction.
"""

from __future__ import annotations

import re

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Canonical / derived tables, in dependency order.
MAPPING: dict[str, str] = {}

MAPPING["store"] = """
SELECT cast(n.n_nationkey as bigint) AS id, n.n_name AS name, r.r_name AS location
FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

MAPPING["users"] = """
SELECT DISTINCT user_id AS user_id, concat('user', cast(user_id as string)) AS name,
       concat('user', cast(user_id as string), '@example.com') AS email
FROM {events}
"""

MAPPING["user_store"] = """
SELECT m.user_id AS user_id, m.store_id AS store_id,
       CASE m.user_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'manager' WHEN 2 THEN 'cashier' ELSE 'staff' END AS role
FROM (SELECT user_id, user_id % 25 AS store_id FROM {users}
      UNION
      SELECT user_id, (user_id * 7 + 3) % 25 AS store_id FROM {users}) m
"""

MAPPING["categories"] = """
SELECT DISTINCT cast(p_partkey % 25 as bigint) * 100 + cast(substring(p_brand, 7) as bigint) AS id,
       cast(p_partkey % 25 as bigint) AS store_id, p_brand AS name
FROM {part} WHERE p_brand <> 'Brand#25'
"""

MAPPING["products"] = """
SELECT p_partkey AS id, cast(p_partkey % 25 as bigint) AS store_id,
       CASE WHEN p_brand <> 'Brand#25'
            THEN cast(p_partkey % 25 as bigint) * 100 + cast(substring(p_brand, 7) as bigint) END AS category_id,
       p_name AS name, p_type AS description,
       concat('S', cast(p_partkey as string)) AS sku, concat('B', cast(p_partkey as string)) AS barcode,
       cast(p_size - 1 as int) AS quantity, cast(p_retailprice as decimal(10,2)) AS price
FROM {part}
"""

MAPPING["customers"] = """
SELECT c_custkey AS id, cast(c_nationkey as bigint) AS store_id, c_name AS name,
       concat(c_name, '@example.com') AS email
FROM {customer}
"""

MAPPING["suppliers"] = """
SELECT s_suppkey AS id, cast(s_nationkey as bigint) AS store_id, s_name AS name,
       concat('desk ', s_name) AS contact_info, concat(s_name, '@example.com') AS email
FROM {supplier}
"""

MAPPING["sales"] = """
SELECT o.o_orderkey AS id, cast(c.c_nationkey as bigint) AS store_id,
       CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE o.o_custkey END AS customer_id,
       cast((o.o_custkey - o.o_custkey % 9) / 9 as bigint) AS user_id,
       o.o_orderpriority AS payment_method, o.o_orderstatus AS payment_status,
       cast(0 as decimal(10,2)) AS discount, cast(0 as decimal(10,2)) AS tax,
       o.o_orderdate AS created_at
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

MAPPING["sale_items"] = """
SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS id,
       l_orderkey AS sale_id, l_partkey AS product_id, cast(l_quantity as int) AS quantity,
       cast(l_extendedprice as decimal(10,2)) AS unit_price
FROM {lineitem} WHERE l_returnflag <> 'R'
"""

MAPPING["purchases"] = """
SELECT DISTINCT l.l_suppkey * 1000 + (year(l.l_shipdate) - 1990) * 12 + month(l.l_shipdate) AS id,
       cast(s.s_nationkey as bigint) AS store_id, l.l_suppkey AS supplier_id, l.l_suppkey % 10 AS user_id,
       date_trunc('month', l.l_shipdate) AS created_at
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
WHERE l.l_returnflag = 'R' AND l.l_suppkey % 10 <> 0
"""

MAPPING["purchase_items"] = """
SELECT l_orderkey * 1000 + 500 + row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS id,
       l_suppkey * 1000 + (year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS purchase_id,
       l_partkey AS product_id, cast(l_quantity as int) AS quantity,
       cast(l_extendedprice as decimal(10,2)) AS unit_price
FROM {lineitem} WHERE l_returnflag = 'R' AND l_suppkey % 10 <> 0
"""

MAPPING["product_reviews"] = """
SELECT event_id AS id, cast({json_k} as bigint) AS product_id,
       CASE WHEN event_id % 20 = 0 THEN NULL ELSE user_id END AS user_id,
       cast(1 + event_id % 5 as int) AS rating, event_type AS review_text, ts AS created_at
FROM {events} WHERE event_type <> 'error'
"""

# Line change records (flat before/after images): one 'I' per line; a 'U'
# for lines with id % 3 = 0 of the headers the update batches touch (sales
# id % 10 = 2: quantity + 1; purchases id % 10 = 4: quantity + 1, price + 1);
# a 'D' for lines of sales with payment_status 'P' and of purchases whose
# supplier_id % 10 = 1. The header's store and acting user travel along.
MAPPING["line_changes"] = """
SELECT si.id * 10 + 1 AS change_id, 'sale_items' AS tbl, 'I' AS op, si.id AS line_id, si.sale_id AS order_id,
       si.product_id AS product_id,
       cast(NULL as int) AS b_quantity, cast(NULL as decimal(10,2)) AS b_unit_price,
       si.quantity AS a_quantity, si.unit_price AS a_unit_price,
       s.store_id AS store_id, s.user_id AS user_id, s.created_at AS ts
FROM {sale_items} si JOIN {sales} s ON si.sale_id = s.id
UNION ALL
SELECT si.id * 10 + 3, 'sale_items', 'U', si.id, si.sale_id, si.product_id, si.quantity, si.unit_price,
       si.quantity + 1, si.unit_price, s.store_id, s.user_id, s.created_at + INTERVAL 12 HOUR
FROM {sale_items} si JOIN {sales} s ON si.sale_id = s.id WHERE s.id % 10 = 2 AND si.id % 3 = 0
UNION ALL
SELECT si.id * 10 + 2, 'sale_items', 'D', si.id, si.sale_id, si.product_id, si.quantity, si.unit_price,
       NULL, NULL, s.store_id, s.user_id, s.created_at + INTERVAL 1 DAY
FROM {sale_items} si JOIN {sales} s ON si.sale_id = s.id WHERE s.payment_status = 'P'
UNION ALL
SELECT pi.id * 10 + 1, 'purchase_items', 'I', pi.id, pi.purchase_id, pi.product_id, NULL, NULL,
       pi.quantity, pi.unit_price, p.store_id, p.user_id, p.created_at
FROM {purchase_items} pi JOIN {purchases} p ON pi.purchase_id = p.id
UNION ALL
SELECT pi.id * 10 + 3, 'purchase_items', 'U', pi.id, pi.purchase_id, pi.product_id, pi.quantity, pi.unit_price,
       pi.quantity + 1, pi.unit_price + cast(1 as decimal(10,2)), p.store_id, p.user_id,
       p.created_at + INTERVAL 12 HOUR
FROM {purchase_items} pi JOIN {purchases} p ON pi.purchase_id = p.id WHERE p.id % 10 = 4 AND pi.id % 3 = 0
UNION ALL
SELECT pi.id * 10 + 2, 'purchase_items', 'D', pi.id, pi.purchase_id, pi.product_id, pi.quantity, pi.unit_price,
       NULL, NULL, p.store_id, p.user_id, p.created_at + INTERVAL 1 DAY
FROM {purchase_items} pi JOIN {purchases} p ON pi.purchase_id = p.id WHERE p.supplier_id % 10 = 1
"""

# Header change records: 'I' for every header; 'U' for the headers the
# update batches touch (id % 10 = 2 for sales, 4 for purchases); 'D' for the
# headers whose lines are deleted above. Suppliers: 'I' for all, 'U' for
# id % 3 = 0, 'D' for id % 10 = 0 (suppliers without purchases).
MAPPING["header_changes"] = """
SELECT id * 10 + 1 AS change_id, 'sales' AS tbl, 'I' AS op, id AS header_id, store_id AS store_id,
       user_id AS user_id, customer_id AS party_id, created_at AS ts FROM {sales}
UNION ALL
SELECT id * 10 + 3, 'sales', 'U', id, store_id, user_id, customer_id, created_at + INTERVAL 12 HOUR FROM {sales} WHERE id % 10 = 2
UNION ALL
SELECT id * 10 + 2, 'sales', 'D', id, store_id, user_id, customer_id, created_at + INTERVAL 1 DAY FROM {sales}
WHERE payment_status = 'P'
UNION ALL
SELECT id * 10 + 1, 'purchases', 'I', id, store_id, user_id, supplier_id, created_at FROM {purchases}
UNION ALL
SELECT id * 10 + 3, 'purchases', 'U', id, store_id, user_id, supplier_id, created_at + INTERVAL 12 HOUR FROM {purchases}
WHERE id % 10 = 4
UNION ALL
SELECT id * 10 + 2, 'purchases', 'D', id, store_id, user_id, supplier_id, created_at + INTERVAL 1 DAY FROM {purchases}
WHERE supplier_id % 10 = 1
"""

MAPPING["supplier_changes"] = """
SELECT id * 10 + 1 AS change_id, 'I' AS op, id, store_id, name, id % 10 AS user_id FROM {suppliers}
UNION ALL
SELECT id * 10 + 3, 'U', id, store_id, name, id % 10 FROM {suppliers} WHERE id % 3 = 0
UNION ALL
SELECT id * 10 + 2, 'D', id, store_id, name, id % 10 FROM {suppliers} WHERE id % 10 = 0
"""

# Direct quantity changes of products (id % 4 = 0), half with a note; plus
# requests naming a product of another store.
MAPPING["quantity_changes"] = """
SELECT p.store_id AS store_id, p.id AS product_id, cast(p.id % 9 - 4 as int) AS quantity, p.price AS unit_price,
       'adjustment' AS type, cast(p.store_id as bigint) AS user_id, cast(NULL as bigint) AS reference_id,
       CASE WHEN p.id % 8 = 0 THEN 'counted' END AS notes
FROM {products} p WHERE p.id % 4 = 0
UNION ALL
SELECT (p.store_id + 1) % 25, p.id, 1, p.price, 'adjustment', cast(p.store_id as bigint), NULL, NULL
FROM {products} p WHERE p.id % 50 = 1
"""

# Action requests: each (user, store) pair of store_pairs asks for three of
# the guarded actions, chosen by an equi-join on a rotating index.
def _actions_values() -> str:
    from ..operators.access import PERMISSIONS
    rows = ", ".join(f"({i}, '{a}')" for i, a in enumerate(PERMISSIONS))
    return f"(VALUES {rows}, ({len(PERMISSIONS)}, 'launch_rocket')) AS a(k, action)"


MAPPING["action_requests"] = "\nUNION ALL\n".join(
    f"""SELECT q.user_id * 1000 + q.store_id * 3 + {j} AS request_id, q.user_id, q.store_id, a.action
FROM {{store_pairs}} q JOIN {_actions_values()} ON a.k = (q.user_id + q.store_id + {j * 12}) % 35"""
    for j in range(3))

# ---- request batches (FIXTURES.md §2.1) ------------------------------------

# The first member of each store acts for it; requests of a store without
# members keep a NULL user (the access check rejects them).
MAPPING["store_actor"] = """
SELECT store_id, min(user_id) AS user_id FROM {user_store} GROUP BY store_id
"""

MAPPING["sale_request_headers"] = """
SELECT s.id AS request_id, s.store_id, a.user_id,
       CASE WHEN s.id % 50 = 1 THEN o.o_custkey + 1 ELSE o.o_custkey END AS customer_id,
       s.payment_method, cast(NULL as string) AS notes, s.created_at AS requested_at
FROM {sales} s JOIN {orders} o ON s.id = o.o_orderkey LEFT JOIN {store_actor} a ON s.store_id = a.store_id
WHERE s.id % 20 = 1
  AND s.id IN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag <> 'R')
"""

MAPPING["sale_request_lines"] = """
SELECT h.request_id,
       row_number() OVER (PARTITION BY h.request_id
           ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_quantity, l.l_extendedprice) AS line_no,
       CASE WHEN l.l_orderkey % 60 = 1 THEN l.l_partkey ELSE l.l_partkey - l.l_partkey % 25 + h.store_id END AS product_id,
       cast(cast(l.l_quantity as int) % 7 + 1 as int) AS quantity,
       cast(NULL as decimal(10,2)) AS unit_price
FROM {sale_request_headers} h JOIN {lineitem} l ON h.request_id = l.l_orderkey
WHERE l.l_returnflag <> 'R'
"""

# The single-line slice: the first line of each request, and per product the
# lowest request -- one line per order and one order per product.
MAPPING["single_sale_request_lines"] = """
SELECT l.* FROM {sale_request_lines} l
JOIN (SELECT product_id, min(request_id) AS request_id FROM {sale_request_lines} WHERE line_no = 1
      GROUP BY product_id) f ON l.request_id = f.request_id AND l.product_id = f.product_id
WHERE l.line_no = 1
"""

MAPPING["single_sale_request_headers"] = """
SELECT h.* FROM {sale_request_headers} h WHERE h.request_id IN (SELECT request_id FROM {single_sale_request_lines})
"""

MAPPING["purchase_request_headers"] = """
SELECT p.id AS request_id, p.store_id, a.user_id,
       CASE WHEN p.id % 50 = 3 THEN p.supplier_id + 1 ELSE p.supplier_id END AS supplier_id,
       cast(NULL as string) AS notes, p.created_at AS requested_at
FROM {purchases} p LEFT JOIN {store_actor} a ON p.store_id = a.store_id
WHERE p.id % 10 = 3
"""

MAPPING["purchase_request_lines"] = """
SELECT h.request_id,
       row_number() OVER (PARTITION BY h.request_id ORDER BY pi.id) AS line_no,
       pi.product_id - pi.product_id % 25 + h.store_id AS product_id,
       pi.quantity, pi.unit_price
FROM {purchase_request_headers} h JOIN {purchase_items} pi ON h.request_id = pi.purchase_id
"""

# Sale updates: sales with id % 10 = 2; the lowest line per (sale, product);
# line id % 3: 0 -> quantity + 1, 1 -> left out, 2 -> unchanged; plus one new
# line of product id % 200 (quantity 1, price 5.00). Header: notes 'upd'.
MAPPING["sale_update_headers"] = """
SELECT s.id AS sale_id, s.store_id, a.user_id, cast(NULL as bigint) AS customer_id,
       cast(NULL as string) AS payment_method, 'upd' AS notes, s.created_at AS requested_at
FROM {sales} s LEFT JOIN {store_actor} a ON s.store_id = a.store_id
WHERE s.id % 10 = 2
UNION ALL  -- somebody without a membership asks for the same orders
SELECT s.id, s.store_id, cast(-5 as bigint), NULL, NULL, 'outsider', s.created_at FROM {sales} s WHERE s.id % 30 = 2
UNION ALL  -- a second request for the same order by the same user
SELECT s.id, s.store_id, a.user_id, NULL, 'cash', 'again', s.created_at
FROM {sales} s LEFT JOIN {store_actor} a ON s.store_id = a.store_id WHERE s.id % 70 = 12
"""

MAPPING["sale_update_lines"] = """
SELECT x.sale_id, x.line_no, x.product_id, x.quantity, x.unit_price FROM (
  SELECT si.sale_id, si.id AS line_no, si.product_id,
         CASE WHEN si.id % 3 = 0 THEN si.quantity + 1 ELSE si.quantity END AS quantity,
         si.unit_price
  FROM {sale_items} si JOIN {sales} h ON si.sale_id = h.id AND h.id % 10 = 2
  JOIN (SELECT min(id) AS first_id FROM {sale_items} GROUP BY sale_id, product_id) f ON si.id = f.first_id
  WHERE si.id % 3 <> 1

  UNION ALL
  SELECT h.id, h.id * 1000 + 999, h.id % 200, 1, cast(5.00 as decimal(10,2))
  FROM {sales} h WHERE h.id % 10 = 2
) x
"""

MAPPING["purchase_update_headers"] = """
SELECT p.id AS purchase_id, p.store_id, a.user_id, cast(NULL as bigint) AS supplier_id,
       'upd' AS notes, p.created_at AS requested_at
FROM {purchases} p LEFT JOIN {store_actor} a ON p.store_id = a.store_id
WHERE p.id % 10 = 4
UNION ALL
SELECT p.id, p.store_id, cast(-5 as bigint), NULL, 'outsider', p.created_at FROM {purchases} p WHERE p.id % 30 = 4
UNION ALL
SELECT p.id, p.store_id, a.user_id, NULL, 'again', p.created_at
FROM {purchases} p LEFT JOIN {store_actor} a ON p.store_id = a.store_id WHERE p.id % 70 = 14
"""

MAPPING["purchase_update_lines"] = """
SELECT x.purchase_id, x.line_no, x.product_id, x.quantity, x.unit_price FROM (
  SELECT pi.purchase_id, pi.id AS line_no, pi.product_id,
         CASE WHEN pi.id % 3 = 0 THEN pi.quantity + 1 ELSE pi.quantity END AS quantity,
         cast(CASE WHEN pi.id % 3 = 0 THEN pi.unit_price + 1 ELSE pi.unit_price END as decimal(10,2)) AS unit_price
  FROM {purchase_items} pi JOIN {purchases} h ON pi.purchase_id = h.id AND h.id % 10 = 4
  JOIN (SELECT min(id) AS first_id FROM {purchase_items} GROUP BY purchase_id, product_id) f ON pi.id = f.first_id
  WHERE pi.id % 3 <> 1

  UNION ALL
  SELECT h.id, h.id * 1000 + 999, h.id % 200, 1, cast(5.00 as decimal(10,2))
  FROM {purchases} h WHERE h.id % 10 = 4
) x
"""

MAPPING["sale_reversals"] = """
SELECT s.id AS sale_id, s.store_id, a.user_id FROM {sales} s LEFT JOIN {store_actor} a ON s.store_id = a.store_id
WHERE s.payment_status = 'P'
UNION ALL
SELECT cast(-1 as bigint), a.store_id, a.user_id FROM {store_actor} a WHERE a.store_id = 1
UNION ALL  -- asked for twice, and by somebody without a membership
SELECT s.id, s.store_id, a.user_id FROM {sales} s LEFT JOIN {store_actor} a ON s.store_id = a.store_id
WHERE s.payment_status = 'P' AND s.id % 4 = 0
UNION ALL
SELECT s.id, s.store_id, cast(-5 as bigint) FROM {sales} s WHERE s.payment_status = 'P' AND s.id % 3 = 0
"""

MAPPING["purchase_reversals"] = """
SELECT p.id AS purchase_id, p.store_id, a.user_id FROM {purchases} p LEFT JOIN {store_actor} a ON p.store_id = a.store_id
WHERE p.id % 10 = 5
UNION ALL
SELECT cast(-1 as bigint), a.store_id, a.user_id FROM {store_actor} a WHERE a.store_id = 1
UNION ALL
SELECT p.id, p.store_id, a.user_id FROM {purchases} p LEFT JOIN {store_actor} a ON p.store_id = a.store_id
WHERE p.id % 20 = 5
"""

# A second batch of purchases, one request per store with many lines: every
# line item whose order falls to the store, moved to a product of the store.
MAPPING["bulk_purchase_headers"] = """
SELECT cast(9000000000 + s.store_id as bigint) AS request_id, s.store_id, m.user_id, s.supplier_id,
       'bulk' AS notes, {ntz} '2024-06-01 00:00:00' AS requested_at
FROM (SELECT store_id, min(id) AS supplier_id FROM {suppliers} GROUP BY store_id) s
JOIN (SELECT store_id, min(user_id) AS user_id FROM {user_store} WHERE role IN ('admin', 'manager')
      GROUP BY store_id) m ON s.store_id = m.store_id
"""

MAPPING["bulk_purchase_lines"] = """
SELECT h.request_id,
       row_number() OVER (PARTITION BY h.request_id ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
           l.l_shipdate, l.l_quantity, l.l_extendedprice) AS line_no,
       p.id AS product_id, cast(l.l_quantity as int) AS quantity, cast(l.l_extendedprice as decimal(10,2)) AS unit_price
FROM {bulk_purchase_headers} h JOIN {lineitem} l ON l.l_orderkey % 25 = h.store_id
JOIN {products} p ON p.id = l.l_partkey - l.l_partkey % 25 + h.store_id
"""

MAPPING["product_inserts"] = """
SELECT p.store_id, p.id + 1000000 AS new_id, a.user_id,
       CASE WHEN p.id % 2 = 1 THEN p.category_id + 1 ELSE p.category_id END AS category_id,
       concat('new ', p.name) AS name, p.description, p.price, p.quantity,
       concat('S', cast(p.id + 1000000 as string)) AS sku, concat('B', cast(p.id + 1000000 as string)) AS barcode
FROM {products} p LEFT JOIN {store_actor} a ON p.store_id = a.store_id
WHERE p.id % 7 = 0
"""

MAPPING["product_patches"] = """
SELECT p.id AS request_id, p.store_id, p.id, a.user_id, cast(p.price + 1 as decimal(10,2)) AS price,
       'patched' AS description, CASE WHEN p.id % 15 = 0 THEN p.category_id + 1 END AS category_id
FROM {products} p LEFT JOIN {store_actor} a ON p.store_id = a.store_id WHERE p.id % 5 = 0
UNION ALL
SELECT cast(-1 as bigint), cast(1 as bigint), cast(-1 as bigint), a.user_id, cast(NULL as decimal(10,2)),
       cast(NULL as string), cast(NULL as bigint) FROM {store_actor} a WHERE a.store_id = 1
UNION ALL  -- a later patch of other columns, and one by somebody without a membership
SELECT p.id + 1000000, p.store_id, p.id, a.user_id, NULL, 'patched again', NULL
FROM {products} p LEFT JOIN {store_actor} a ON p.store_id = a.store_id WHERE p.id % 10 = 0
UNION ALL
SELECT p.id + 2000000, p.store_id, p.id, cast(-5 as bigint), cast(0 as decimal(10,2)), 'outsider', NULL
FROM {products} p WHERE p.id % 25 = 0
"""

MAPPING["product_deletes"] = """
SELECT p.store_id, p.id, m.user_id FROM {products} p
LEFT JOIN (SELECT store_id, min(user_id) AS user_id FROM {user_store} WHERE role = 'admin' GROUP BY store_id) m
  ON p.store_id = m.store_id WHERE p.id % 11 = 0
UNION ALL
SELECT a.store_id, cast(-1 as bigint), a.user_id FROM {user_store} a WHERE a.role = 'admin' AND a.user_id % 12 = 0
UNION ALL  -- a second time, and by the first member, whatever the role
SELECT p.store_id, p.id, m.user_id FROM {products} p
LEFT JOIN (SELECT store_id, min(user_id) AS user_id FROM {user_store} WHERE role = 'admin' GROUP BY store_id) m
  ON p.store_id = m.store_id WHERE p.id % 22 = 0
UNION ALL
SELECT p.store_id, p.id, a.user_id FROM {products} p LEFT JOIN {store_actor} a ON p.store_id = a.store_id
WHERE p.id % 33 = 0
"""

MAPPING["review_requests"] = """
SELECT r.id + 5000000 AS request_id,
       CASE WHEN r.id % 8 = 4 THEN (r.product_id + 1) % 25 ELSE r.product_id % 25 END AS store_id,
       r.product_id, coalesce(r.user_id, 0) AS user_id, cast(r.id % 7 as int) AS rating, r.review_text
FROM {product_reviews} r WHERE r.id % 4 = 0
"""

MAPPING["supplier_requests"] = """
SELECT s.store_id, a.user_id, s.id AS request_id,
       CASE WHEN s.id % 2 = 0 THEN upper(s.name) ELSE concat('New ', s.name) END AS name,
       s.contact_info, s.email
FROM {suppliers} s LEFT JOIN {store_actor} a ON s.store_id = a.store_id
"""

MAPPING["supplier_patches"] = """
SELECT s.id AS request_id, s.store_id, s.id, a.user_id, n.name, '1' AS phone
FROM {suppliers} s JOIN {suppliers} n ON n.id = s.id + 1 LEFT JOIN {store_actor} a ON s.store_id = a.store_id
WHERE s.id % 3 = 0
UNION ALL  -- several suppliers of a store ask for one new name; a later patch of the same supplier
SELECT s.id + 1000000, s.store_id, s.id, a.user_id, 'The one', NULL
FROM {suppliers} s LEFT JOIN {store_actor} a ON s.store_id = a.store_id WHERE s.id % 2 = 0
UNION ALL
SELECT s.id + 2000000, s.store_id, s.id, a.user_id, NULL, '2'
FROM {suppliers} s LEFT JOIN {store_actor} a ON s.store_id = a.store_id WHERE s.id % 6 = 0
"""

MAPPING["supplier_deletes"] = """
SELECT s.store_id, s.id, a.user_id FROM {suppliers} s LEFT JOIN {store_actor} a ON s.store_id = a.store_id
UNION ALL  -- a second time
SELECT s.store_id, s.id, a.user_id FROM {suppliers} s LEFT JOIN {store_actor} a ON s.store_id = a.store_id
WHERE s.id % 20 = 0
"""

MAPPING["category_inserts"] = """
SELECT c.store_id, c.id + 100000 AS id, a.user_id,
       CASE WHEN c.id % 3 = 0 THEN lower(c.name) WHEN c.id % 3 = 2 THEN repeat(concat(c.name, ' '), 15) END AS name,
       concat('about ', c.name) AS description
FROM {categories} c LEFT JOIN {store_actor} a ON c.store_id = a.store_id
"""

MAPPING["category_updates"] = """
SELECT c.id AS request_id, c.store_id, c.id, a.user_id, upper(c.name) AS name, cast(NULL as string) AS description
FROM {categories} c LEFT JOIN {store_actor} a ON c.store_id = a.store_id WHERE c.id % 2 = 0
UNION ALL  -- a later update of the same category; an unknown one
SELECT c.id + 1000000, c.store_id, c.id, a.user_id, lower(c.name), 'later'
FROM {categories} c LEFT JOIN {store_actor} a ON c.store_id = a.store_id WHERE c.id % 4 = 0
UNION ALL
SELECT cast(-1 as bigint) - a.store_id, a.store_id, cast(-1 as bigint), a.user_id, 'none', NULL FROM {store_actor} a
"""

MAPPING["category_deletes"] = """
SELECT c.store_id, c.id, a.user_id FROM {categories} c LEFT JOIN {store_actor} a ON c.store_id = a.store_id
WHERE c.id % 4 = 1
UNION ALL  -- a second time; an unknown one
SELECT c.store_id, c.id, a.user_id FROM {categories} c LEFT JOIN {store_actor} a ON c.store_id = a.store_id
WHERE c.id % 8 = 1
UNION ALL
SELECT a.store_id, cast(-1 as bigint), a.user_id FROM {store_actor} a
"""

MAPPING["store_creates"] = """
SELECT a.user_id, s.id + 100 AS new_id, concat(s.name, ' annex') AS name,
       CASE WHEN s.id % 5 = 0 THEN ' ' ELSE s.location END AS location,
       cast(NULL as string) AS owner_name
FROM {store} s LEFT JOIN {store_actor} a ON s.id = a.store_id
"""

# Acting (user, store) pairs for store changes: the user's own store and the
# next one (mostly not a member there).
MAPPING["store_pairs"] = """
SELECT user_id, user_id % 25 AS store_id FROM {users}
UNION
SELECT user_id, (user_id + 1) % 25 FROM {users}
"""

MAPPING["store_updates"] = """
SELECT u.user_id * 2 AS request_id, u.user_id, s.id, concat(s.name, ' main') AS name, s.location, 'owner' AS owner_name
FROM {store} s JOIN {store_pairs} u ON s.id = u.store_id WHERE s.id % 2 = 0
UNION ALL  -- the same user once more
SELECT u.user_id * 2 + 1, u.user_id, s.id, concat(s.name, ' again'), s.location, cast(u.user_id as string)
FROM {store} s JOIN {store_pairs} u ON s.id = u.store_id WHERE s.id % 4 = 0
"""

MAPPING["store_deletes"] = """
SELECT u.user_id, s.id FROM {store} s JOIN {store_pairs} u ON s.id = u.store_id WHERE s.id % 8 = 0
"""

MAPPING["user_removals"] = """
SELECT user_id FROM {users} WHERE user_id % 6 = 0
"""

MAPPING["membership_requests"] = """
SELECT user_id, CASE WHEN user_id % 5 = 4 THEN cast(99 as bigint) ELSE (user_id + 1) % 25 END AS store_id,
       CASE user_id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'manager' WHEN 2 THEN 'staff'
                        WHEN 3 THEN 'cashier' ELSE 'staff' END AS role
FROM {users}
UNION ALL
SELECT cast(-1 as bigint), cast(1 as bigint), 'staff'
"""

MAPPING["role_updates"] = """
SELECT user_id * 10 + 1 AS request_id, user_id, user_id % 25 AS store_id, 'staff' AS role FROM {users}
UNION ALL
SELECT user_id * 10 + 2, user_id, (user_id + 2) % 25, CASE WHEN user_id % 2 = 0 THEN 'manager' ELSE 'owner' END
FROM {users}
UNION ALL
SELECT user_id * 10 + 3, user_id, user_id % 25, 'manager' FROM {users} WHERE user_id % 3 = 0
"""

MAPPING["user_imports"] = """
SELECT user_id + 1000000 AS request_id, concat('user', cast(user_id + 1000000 as string)) AS name,
       email FROM {users}
UNION ALL
SELECT user_id + 2000000, concat('new', cast(user_id as string)),
       concat('user', cast(user_id + 1000000 as string), '@example.com') FROM {users}
"""

MAPPING["products_raw"] = """
SELECT id, store_id, name,
       CASE WHEN id % 10 = 2 THEN '  ' ELSE barcode END AS barcode,
       CASE WHEN id % 10 = 0 THEN '-1' WHEN id % 10 = 1 THEN 'x' ELSE cast(quantity as string) END AS quantity,
       cast(price as string) AS price
FROM {products}
"""

# A stored stock snapshot that has drifted: some quantities off by one, some
# products missing, some unknown ones.
MAPPING["stored_products"] = """
SELECT id, store_id, cast(CASE WHEN id % 10 = 3 THEN quantity + 1 ELSE quantity END as int) AS quantity,
       quantity AS opening, true AS known
FROM {products} WHERE id % 10 <> 4
UNION ALL
SELECT id + 10000000, store_id, quantity, quantity, false FROM {products} WHERE id % 10 = 5
"""

# Tables with dangling keys for the reference check.
MAPPING["dangling_products"] = """
SELECT id, CASE WHEN id % 9 = 0 THEN category_id + 1000000 ELSE category_id END AS category_id FROM {products}
"""

MAPPING["dangling_reviews"] = """
SELECT id, CASE WHEN id % 8 = 0 THEN product_id + 10000000 ELSE product_id END AS product_id,
       CASE WHEN id % 7 = 0 THEN user_id + 10000000 ELSE user_id END AS user_id FROM {product_reviews}
"""

MAPPING["dangling_categories"] = """
SELECT id, CASE WHEN id % 6 = 0 THEN store_id + 1000 ELSE store_id END AS store_id FROM {categories}
"""

MAPPING["reviews_raw"] = """
SELECT id, product_id,
       CASE WHEN id % 10 = 0 THEN '0' WHEN id % 10 = 1 THEN '6' WHEN id % 10 = 2 THEN 'x'
            ELSE cast(rating as string) END AS rating,
       CASE WHEN id % 10 = 3 THEN ' ' ELSE review_text END AS review_text
FROM {product_reviews}
"""

# Key sets for detail lookups: a third of the rows with their own store,
# some with the next store (not found there), and one unknown id.
for _name, _src in (("product_keys", "products"), ("supplier_keys", "suppliers"),
                    ("category_keys", "categories")):
    MAPPING[_name] = f"""
SELECT store_id, id FROM {{{_src}}} WHERE id % 3 = 0
UNION ALL
SELECT (store_id + 1) % 25, id FROM {{{_src}}} WHERE id % 7 = 1
UNION ALL
SELECT cast(1 as bigint), cast(-1 as bigint)
"""

_REF = re.compile(r"\{(\w+)\}")

JSON_K = {
    "spark": "get_json_object(props, '$.k')",
    "duckdb": "json_extract_string(props, '$.k')",
}


# the type name of a naive timestamp literal
NTZ = {"spark": "TIMESTAMP_NTZ", "duckdb": "TIMESTAMP"}


def references(sql: str) -> list[str]:
    return [m for m in _REF.findall(sql) if m not in ("json_k", "ntz")]


def closure(names: list[str]) -> list[str]:
    """Mapping entries needed to define ``names``, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n not in MAPPING:
            return
        for r in references(MAPPING[n]):
            visit(r)
        order.append(n)

    for n in names:
        visit(n)
    return order


def render(sql: str, engine: str) -> str:
    """Plain SQL text for ``engine`` with table references as bare names."""
    sql = sql.replace("{json_k}", JSON_K[engine]).replace("{ntz}", NTZ[engine])
    return _REF.sub(lambda m: m.group(1), sql)
