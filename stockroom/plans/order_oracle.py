"""DuckDB oracle text for the order write paths.

The general post_sales is order-dependent; its oracle simulates one-by-one
posting with a recursive CTE (one request per step, stock carried as a MAP),
which shares nothing with the set-based rounds of the Spark operator.
"""

from __future__ import annotations

from .oracle import oracle
from .order_plans import AS_OF

TS = f"TIMESTAMP '{AS_OF}'"


def _guard(roles) -> str:
    inlist = ", ".join(f"'{r}'" for r in roles)
    return (f"WHEN g.role IS NULL THEN 'Access denied' WHEN g.role NOT IN ({inlist}) "
            f"THEN 'Insufficient permissions'")


# -- post_sales on the single-line slice: no contention, so join and compare
_SL = ("x", f"""
SELECT h.request_id,
       CASE {_guard(('admin', 'manager', 'cashier'))}
            WHEN h.customer_id IS NOT NULL AND h.customer_id <> 0 AND NOT EXISTS (
                 SELECT 1 FROM {{customers}} c WHERE c.id = h.customer_id AND c.store_id = h.store_id)
            THEN 'Invalid Customer'
            WHEN p.id IS NULL THEN 'Product with ID ' || cast(l.product_id as varchar) || ' not found in store'
            WHEN l.quantity IS NULL OR l.quantity <= 0 THEN 'Invalid quantity'
            WHEN p.quantity < l.quantity THEN 'Not enough stock for product ' || p.name END AS reason
FROM {{single_sale_request_headers}} h
JOIN {{single_sale_request_lines}} l ON l.request_id = h.request_id
LEFT JOIN {{user_store}} g ON g.user_id = h.user_id AND g.store_id = h.store_id
LEFT JOIN {{products}} p ON p.id = l.product_id AND p.store_id = h.store_id
""")
oracle("post_sales_single_line", """
SELECT request_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM {x}
""", [_SL])

# -- post_purchases
_PL = ("pl", """
SELECT l.*, row_number() OVER (PARTITION BY l.request_id ORDER BY l.line_no) - 1 AS pos
FROM {purchase_request_lines} l
""")
_PP = ("pp", f"""
SELECT h.*,
       CASE {_guard(('admin', 'manager'))}
            WHEN NOT EXISTS (SELECT 1 FROM {{suppliers}} s WHERE s.id = h.supplier_id AND s.store_id = h.store_id)
            THEN 'Invalid Supplier'
            WHEN NOT EXISTS (SELECT 1 FROM {{pl}} l WHERE l.request_id = h.request_id) THEN 'Items are required'
            WHEN EXISTS (SELECT 1 FROM {{pl}} l WHERE l.request_id = h.request_id AND NOT EXISTS (
                 SELECT 1 FROM {{products}} p WHERE p.id = l.product_id AND p.store_id = h.store_id))
            THEN 'Product with ID ' || cast((SELECT arg_min(l.product_id, l.pos) FROM {{pl}} l
                 WHERE l.request_id = h.request_id AND NOT EXISTS (
                   SELECT 1 FROM {{products}} p WHERE p.id = l.product_id AND p.store_id = h.store_id)) as varchar)
                 || ' not found in store' END AS reason
FROM {{purchase_request_headers}} h
LEFT JOIN {{user_store}} g ON g.user_id = h.user_id AND g.store_id = h.store_id
""")
_PN = ("pn", """
SELECT pp.*, (SELECT max(id) FROM {purchases}) + row_number() OVER (ORDER BY requested_at, request_id) AS id
FROM {pp} WHERE reason IS NULL
""")
_PNL = ("pnl", """
SELECT (SELECT max(id) FROM {purchase_items}) + row_number() OVER (ORDER BY n.id, l.pos) AS id, n.id AS purchase_id,
       l.product_id, l.quantity, l.unit_price, row_number() OVER (ORDER BY n.id, l.pos) AS change_id
FROM {pl} l JOIN {pn} n ON l.request_id = n.request_id
""")
_PCH = [_PL, _PP, _PN, _PNL]
oracle("post_purchases", f"""
SELECT id, store_id, supplier_id, user_id, notes, requested_at AS created_at,
       {TS} AS updated_at, cast(NULL as timestamp) AS last_updated_at
FROM {{pn}}
""", _PCH)
oracle("post_purchases_lines", "SELECT * EXCLUDE (change_id) FROM {pnl}", _PCH)

# -- two batches in a row: every request of the second is valid by its making
_B = ("b", """
SELECT h.*, (SELECT max(id) FROM {pn}) + row_number() OVER (ORDER BY requested_at, request_id) AS id
FROM {bulk_purchase_headers} h WHERE request_id IN (SELECT request_id FROM {bulk_purchase_lines})
""")
_BL = ("bl", """
SELECT (SELECT max(id) FROM {pnl}) + row_number() OVER (ORDER BY b.id, l.line_no) AS id, b.id AS purchase_id,
       l.product_id, l.quantity, l.unit_price,
       (SELECT max(change_id) FROM {pnl}) + row_number() OVER (ORDER BY b.id, l.line_no) AS change_id
FROM {bulk_purchase_lines} l JOIN {b} b ON l.request_id = b.request_id
""")
_BOTH = ("both_lines", "SELECT * FROM {pnl} UNION ALL SELECT * FROM {bl}")
_CHAIN = [*_PCH, _B, _BL, _BOTH]
oracle("post_purchases_chain", """
SELECT * EXCLUDE (change_id) FROM {both_lines}
WHERE (SELECT count(*) = count(DISTINCT id) FROM (SELECT id FROM {both_lines} UNION ALL SELECT id FROM {purchase_items}))
""", _CHAIN)
oracle("post_purchases_chain_changes", """
SELECT change_id, id AS line_id FROM {both_lines}
WHERE (SELECT count(*) = count(DISTINCT change_id) FROM {both_lines})
""", _CHAIN)
oracle("post_purchases_chain_products", f"""
SELECT p.* REPLACE (cast(p.quantity + coalesce(m.q, 0) as int) AS quantity,
                    CASE WHEN m.q IS NULL THEN p.updated_at ELSE {TS} END AS updated_at)
FROM {{products}} p LEFT JOIN (SELECT product_id, sum(quantity) AS q FROM {{both_lines}} GROUP BY product_id) m
  ON p.id = m.product_id
""", _CHAIN)
oracle("post_purchases_rejects", "SELECT request_id, reason FROM {pp} WHERE reason IS NOT NULL", [_PL, _PP])


# -- updates
def _updates(kind: str):
    sale = kind == "sale"
    key = "sale_id" if sale else "purchase_id"
    heads, items = ("sales", "sale_items") if sale else ("purchases", "purchase_items")
    party, parties, msg = (("customer_id", "customers", "Invalid Customer") if sale
                           else ("supplier_id", "suppliers", "Invalid Supplier"))
    req_h, req_l = f"{kind}_update_headers", f"{kind}_update_lines"
    sign = -1 if sale else 1
    rb = ("rb", f"""
SELECT h.*, CASE {_guard(('admin', 'manager'))}
       WHEN h.{party} IS NOT NULL AND h.{party} <> 0 AND NOT EXISTS (
            SELECT 1 FROM {{{parties}}} c WHERE c.id = h.{party} AND c.store_id = h.store_id) THEN '{msg}'
       WHEN NOT EXISTS (SELECT 1 FROM {{{heads}}} s WHERE s.id = h.{key} AND s.store_id = h.store_id)
       THEN '{"Sale not found" if sale else "Purchase not found"}'
       WHEN EXISTS (SELECT 1 FROM {{{req_l}}} l WHERE l.{key} = h.{key} GROUP BY l.product_id HAVING count(*) > 1)
       THEN 'Duplicate product in items' END AS reason
FROM {{{req_h}}} h LEFT JOIN {{user_store}} g ON g.user_id = h.user_id AND g.store_id = h.store_id
""")
    r = ("r", f"""
SELECT * REPLACE (CASE WHEN reason IS NULL AND count(*) FILTER (reason IS NULL) OVER (PARTITION BY {key}) > 1
                       THEN 'Several requests for one order in a batch' ELSE reason END AS reason) FROM {{rb}}
""")
    new = ("nw", f"""
SELECT l.{key}, l.product_id, l.quantity AS new_q, l.unit_price AS new_p,
       row_number() OVER (PARTITION BY l.{key} ORDER BY l.line_no) - 1 AS pos
FROM {{{req_l}}} l WHERE l.{key} IN (SELECT {key} FROM {{r}} WHERE reason IS NULL)
""")
    old = ("od", f"SELECT i.* FROM {{{items}}} i WHERE i.{key} IN (SELECT {key} FROM {{r}} WHERE reason IS NULL)")
    first = ("fi", f"SELECT {key}, product_id, min(id) AS id FROM {{od}} GROUP BY {key}, product_id")
    inserted = ("ni", f"""
SELECT n.*, (SELECT max(id) FROM {{{items}}}) + row_number() OVER (ORDER BY n.{key}, n.pos) AS id FROM {{nw}} n
WHERE NOT EXISTS (SELECT 1 FROM {{od}} o WHERE o.{key} = n.{key} AND o.product_id = n.product_id)
""")
    ctes = [rb, r, new, old, first, inserted]
    price = "o.unit_price" if sale else "n.new_p"
    if sale:
        header = f"""
SELECT s.id, s.store_id, coalesce(r.customer_id, s.customer_id) AS customer_id, s.user_id,
       coalesce(r.payment_method, s.payment_method) AS payment_method, s.payment_status, s.discount, s.tax,
       coalesce(r.notes, s.notes) AS notes, s.created_at, {TS} AS updated_at, s.last_updated_at
FROM {{sales}} s JOIN {{r}} r ON s.id = r.sale_id WHERE r.reason IS NULL"""
    else:
        header = f"""
SELECT s.id, s.store_id, coalesce(r.supplier_id, s.supplier_id) AS supplier_id, s.user_id,
       coalesce(r.notes, s.notes) AS notes, s.created_at, {TS} AS updated_at, s.last_updated_at
FROM {{purchases}} s JOIN {{r}} r ON s.id = r.purchase_id WHERE r.reason IS NULL"""
    oracle(f"apply_{kind}_updates", header, ctes)
    oracle(f"apply_{kind}_updates_lines", f"""
SELECT o.* FROM {{od}} o
WHERE EXISTS (SELECT 1 FROM {{nw}} n WHERE n.{key} = o.{key} AND n.product_id = o.product_id)
  AND o.id NOT IN (SELECT id FROM {{fi}})
UNION ALL
SELECT f.id, f.{key}, f.product_id, n.new_q, {price}
FROM {{fi}} f JOIN {{nw}} n ON n.{key} = f.{key} AND n.product_id = f.product_id JOIN {{od}} o ON o.id = f.id
UNION ALL
SELECT n.id, n.{key}, n.product_id, n.new_q, n.new_p FROM {{ni}} n
""", ctes)
    oracle(f"apply_{kind}_updates_stock", f"""
SELECT product_id, cast(sum(d) as bigint) AS delta FROM (
  SELECT f.product_id, {sign} * (n.new_q - o.quantity) AS d
  FROM {{fi}} f JOIN {{nw}} n ON n.{key} = f.{key} AND n.product_id = f.product_id JOIN {{od}} o ON o.id = f.id
  UNION ALL
  SELECT n.product_id, {sign} * n.new_q FROM {{nw}} n
  WHERE NOT EXISTS (SELECT 1 FROM {{od}} o WHERE o.{key} = n.{key} AND o.product_id = n.product_id)
  UNION ALL
  SELECT o.product_id, {-sign} * o.quantity FROM {{od}} o
  WHERE NOT EXISTS (SELECT 1 FROM {{nw}} n WHERE n.{key} = o.{key} AND n.product_id = o.product_id)
) x GROUP BY product_id
""", ctes)
    oracle(f"apply_{kind}_updates_rejects", f"SELECT {key}, store_id, reason FROM {{r}} WHERE reason IS NOT NULL",
           ctes)


_updates("sale")
_updates("purchase")


def _reversals(kind: str):
    sale = kind == "sale"
    key = "sale_id" if sale else "purchase_id"
    heads, items = ("sales", "sale_items") if sale else ("purchases", "purchase_items")
    sign = 1 if sale else -1
    rb = ("rb", f"""
SELECT q.*, CASE {_guard(('admin', 'manager'))}
       WHEN NOT EXISTS (SELECT 1 FROM {{{heads}}} s WHERE s.id = q.{key} AND s.store_id = q.store_id)
       THEN '{"Sale not found" if sale else "Purchase not found"}' END AS reason
FROM {{{kind}_reversals}} q LEFT JOIN {{user_store}} g ON g.user_id = q.user_id AND g.store_id = q.store_id
""")
    r = ("r", f"""
SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY {key}, reason IS NULL ORDER BY user_id) > 1
                       THEN '{"Sale not found" if sale else "Purchase not found"}' ELSE reason END AS reason) FROM {{rb}}
""")
    ok = f"(SELECT {key} FROM {{r}} WHERE reason IS NULL)"
    oracle(f"reverse_{kind}s", f"SELECT * FROM {{{heads}}} WHERE id NOT IN {ok}", [rb, r])
    oracle(f"reverse_{kind}s_lines", f"SELECT * FROM {{{items}}} WHERE {key} NOT IN {ok}", [rb, r])
    oracle(f"reverse_{kind}s_stock", f"""
SELECT product_id, cast(sum({sign} * quantity) as bigint) AS delta FROM {{{items}}} WHERE {key} IN {ok}
GROUP BY product_id
""", [rb, r])
    oracle(f"reverse_{kind}s_rejects", f"SELECT {key}, store_id, reason FROM {{r}} WHERE reason IS NOT NULL", [rb, r])


_reversals("sale")
_reversals("purchase")


# -- the general post_sales: one-by-one posting, simulated by a recursive CTE
# that carries the stock of every product as a MAP and takes one request per
# step in (requested_at, request_id) order. Independent of the set-based
# rounds of the Spark operator.
_PS_HDR = ("hdr", f"""
SELECT h.*, CASE {_guard(('admin', 'manager', 'cashier'))}
            WHEN h.customer_id IS NOT NULL AND h.customer_id <> 0 AND NOT EXISTS (
                 SELECT 1 FROM {{customers}} c WHERE c.id = h.customer_id AND c.store_id = h.store_id)
            THEN 'Invalid Customer' END AS head_reason,
       row_number() OVER (ORDER BY h.requested_at, h.request_id) AS k
FROM {{sale_request_headers}} h LEFT JOIN {{user_store}} g ON g.user_id = h.user_id AND g.store_id = h.store_id
""")
_PS_RL = ("rl", """
SELECT h.k, h.request_id, h.head_reason,
       (SELECT list(struct_pack(p := l.product_id, q := l.quantity, found := pr.id IS NOT NULL, name := pr.name)
                    ORDER BY l.line_no)
        FROM {sale_request_lines} l LEFT JOIN {products} pr ON pr.id = l.product_id AND pr.store_id = h.store_id
        WHERE l.request_id = h.request_id) AS items
FROM {hdr} h
""")
_OWN_BEFORE = ("coalesce(list_sum(list_transform(list_filter(r.items[1:i - 1], lambda y: y.p = x.p), "
               "lambda y: y.q)), 0)")
_LINE_MSGS = (f"list_transform(r.items, lambda x, i: CASE "
              f"WHEN NOT x.found THEN 'Product with ID ' || cast(x.p as varchar) || ' not found in store' "
              f"WHEN x.q IS NULL OR x.q <= 0 THEN 'Invalid quantity' "
              f"WHEN s.stock[x.p] - {_OWN_BEFORE} < x.q THEN 'Not enough stock for product ' || x.name END)")
_REASON = (f"coalesce(r.head_reason, CASE WHEN r.items IS NULL THEN 'Items are required' END, "
           f"list_filter({_LINE_MSGS}, lambda m: m IS NOT NULL)[1])")
_TAKE = ("map_from_entries(list_transform(map_entries(s.stock), lambda e: struct_pack(key := e.key, "
         "value := e.value - coalesce(list_sum(list_transform(list_filter(r.items, lambda y: y.p = e.key), "
         "lambda y: y.q)), 0))))")
_PS_SIM = ("sim", f"""
SELECT cast(0 as bigint) AS k,
       (SELECT map(list(id ORDER BY id), list(cast(quantity as bigint) ORDER BY id)) FROM {{products}}) AS stock,
       cast(NULL as bigint) AS request_id, cast(NULL as varchar) AS reason
UNION ALL
SELECT r.k, CASE WHEN {_REASON} IS NULL THEN {_TAKE} ELSE s.stock END, r.request_id, {_REASON}
FROM sim s JOIN {{rl}} r ON r.k = s.k + 1
""")
_PS = [_PS_HDR, _PS_RL, _PS_SIM]
oracle("post_sales_verdicts", """
SELECT request_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason
FROM {sim} WHERE k > 0
""", _PS, recursive=True)
_PS_NEW = ("nsale", """
SELECT h.*, (SELECT max(id) FROM {sales}) + row_number() OVER (ORDER BY h.requested_at, h.request_id) AS id
FROM {hdr} h JOIN {sim} s ON s.request_id = h.request_id WHERE s.k > 0 AND s.reason IS NULL
""")
_PS_LINES = ("nline", """
SELECT (SELECT max(id) FROM {sale_items}) + row_number() OVER (ORDER BY n.id, l.line_no) AS id, n.id AS sale_id,
       l.product_id, l.quantity, p.price AS unit_price, row_number() OVER (ORDER BY n.id, l.line_no) AS change_id,
       n.store_id, n.user_id, n.requested_at
FROM {sale_request_lines} l JOIN {nsale} n ON n.request_id = l.request_id
JOIN {products} p ON p.id = l.product_id AND p.store_id = n.store_id
""")
_PSN = [*_PS, _PS_NEW, _PS_LINES]
oracle("post_sales", f"""
SELECT id, store_id, customer_id, user_id, payment_method, 'pending' AS payment_status,
       cast(0 as decimal(10,2)) AS discount, cast(0 as decimal(10,2)) AS tax, notes,
       requested_at AS created_at, {TS} AS updated_at, cast(NULL as timestamp) AS last_updated_at
FROM {{nsale}}
""", _PSN, recursive=True)
oracle("post_sales_lines", "SELECT id, sale_id, product_id, quantity, unit_price FROM {nline}", _PSN, recursive=True)
oracle("post_sales_ledger", """
SELECT change_id, store_id, product_id, 'sale' AS type, cast(-quantity as int) AS quantity,
       cast(unit_price as decimal(10,2)) AS unit_price, user_id AS created_by, sale_id AS reference_id,
       'Sale transaction' AS notes, requested_at AS created_at FROM {nline}
""", _PSN, recursive=True)
oracle("post_sales_products", f"""
SELECT p.* REPLACE (cast(p.quantity - coalesce(m.q, 0) as int) AS quantity,
                    CASE WHEN m.q IS NULL THEN p.updated_at ELSE {TS} END AS updated_at)
FROM {{products}} p LEFT JOIN (SELECT product_id, sum(quantity) AS q FROM {{nline}} GROUP BY product_id) m
  ON p.id = m.product_id
""", _PSN, recursive=True)
