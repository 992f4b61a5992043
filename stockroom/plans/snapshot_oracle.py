"""DuckDB oracle text for stored batch results, current totals, late streams, mixed files and the SQL surface."""

from __future__ import annotations

from .ledger_oracle import STOCK_LEDGER
from .oracle import MONEY, ORACLE, oracle
from .registry import RANGE_END, RANGE_START
from .sql_plans import STORE
from .stream_plans import ARRIVALS, DELAY_DAYS


def _wrapped(name: str, alias: str) -> str:
    """The SQL text of another query as a subquery."""
    return f"({ORACLE[name]}) {alias}"


def _stored(kind: str, products: str, heads: str, lines: str) -> str:
    return f"""
SELECT 'products' AS tbl, id, store_id, cast(NULL as bigint) AS order_id, cast(NULL as bigint) AS product_id, quantity,
       price AS amount, updated_at AS at FROM {products}
UNION ALL
SELECT '{kind}s', id, store_id, NULL, NULL, cast(NULL as int), cast(NULL as decimal(10,2)), created_at FROM {heads}
UNION ALL
SELECT '{kind}_items', id, cast(NULL as bigint), {kind}_id, product_id, quantity, unit_price, cast(NULL as timestamp) FROM {lines}
"""


def _canonical(name: str) -> str:
    from .oracle import sql
    return f"({sql(f'SELECT * FROM {{{name}}}')}) c_{name}"


def _snapshot(query: str, kind: str, products: str, heads: str, lines: str) -> None:
    ORACLE[query] = _stored(kind, products, heads, lines)


def _moved(stock: str) -> str:
    """Products after a batch, from its net stock change per product."""
    from .order_oracle import TS
    return f"""(SELECT p.* REPLACE (cast(p.quantity + coalesce(m.delta, 0) as int) AS quantity,
    CASE WHEN m.product_id IS NULL THEN p.updated_at ELSE {TS} END AS updated_at)
  FROM {_canonical('products')} p LEFT JOIN {_wrapped(stock, 'm')} ON m.product_id = p.id) moved""".replace(
        "c_products p LEFT", "p LEFT")


def _and(table: str, query: str) -> str:
    return f"(SELECT * FROM {_canonical(table)} UNION ALL SELECT * FROM {_wrapped(query, 'q')}) both_{table}"


def _instead(table: str, query: str, key: str = "id") -> str:
    """``table`` with the rows of ``query`` in place of those with their key."""
    return (f"(SELECT * FROM {_canonical(table)} WHERE {key} NOT IN (SELECT {key} FROM {_wrapped(query, 'k')}) "
            f"UNION ALL SELECT * FROM {_wrapped(query, 'q')}) new_{table}")


def register_all() -> None:
    from . import order_oracle  # noqa: F401  (its texts are part of these)
    _snapshot("post_sales_snapshot", "sale", _wrapped("post_sales_products", "p"), _and("sales", "post_sales"),
              _and("sale_items", "post_sales_lines"))
    oracle("post_purchases_products", ORACLE_PRODUCTS, order_oracle._PCH)
    products = _wrapped("post_purchases_products", "p")
    _snapshot("post_purchases_snapshot", "purchase", products, _and("purchases", "post_purchases"),
              _and("purchase_items", "post_purchases_lines"))
    del ORACLE["post_purchases_products"]
    # an update without items keeps its lines: the update's own lines are those of orders with items
    _snapshot("apply_sale_updates_snapshot", "sale", _moved("apply_sale_updates_stock"),
              _instead("sales", "apply_sale_updates"), _instead("sale_items", "apply_sale_updates_lines", "sale_id"))
    _snapshot("reverse_sales_snapshot", "sale", _moved("reverse_sales_stock"), _wrapped("reverse_sales", "h"),
              _wrapped("reverse_sales_lines", "l"))


ORACLE_PRODUCTS = """
SELECT p.* REPLACE (cast(p.quantity + coalesce(m.q, 0) as int) AS quantity,
                    CASE WHEN m.q IS NULL THEN p.updated_at ELSE TIMESTAMP '2024-06-30 00:00:00' END AS updated_at)
FROM {products} p LEFT JOIN (SELECT product_id, sum(quantity) AS q FROM {pnl} GROUP BY product_id) m ON p.id = m.product_id
"""

register_all()


# -- totals after all changes: full recompute from the last image of every line
def _totals(kind: str, gone: str) -> None:
    heads, items, key = f"{kind}s", f"{kind}_items", f"{kind}_id"
    last = ("last", f"""
SELECT order_id, line_id, a_quantity AS q, a_unit_price AS p, op FROM {{line_changes}} WHERE tbl = '{items}'
QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY CASE op WHEN 'I' THEN 1 WHEN 'U' THEN 2 ELSE 3 END DESC) = 1
""")
    # a line that was changed and deleted leaves with the amounts that its two records say
    oracle(f"{kind}_totals_current", f"""
SELECT h.id AS {key}, h.store_id,
       cast(coalesce(sum(coalesce(c.a_quantity * c.a_unit_price, 0) - coalesce(c.b_quantity * c.b_unit_price, 0)), 0) as {MONEY})
         AS total_amount,
       cast(coalesce(sum(CASE c.op WHEN 'I' THEN 1 WHEN 'D' THEN -1 ELSE 0 END), 0) as bigint) AS total_items
FROM {{{heads}}} h LEFT JOIN {{line_changes}} c ON c.tbl = '{items}' AND c.order_id = h.id
WHERE NOT ({gone})
GROUP BY h.id, h.store_id
""", [last])


_totals("sale", "coalesce(h.payment_status, '') = 'P'")
_totals("purchase", "h.supplier_id % 10 = 1")

# -- late records: a first delivery older than the delay behind what earlier runs had seen is lost
_DUE = ("due", f"""
SELECT change_id, ts, CASE WHEN ts < TIMESTAMP '{ARRIVALS[0]}' THEN 1 WHEN ts < TIMESTAMP '{ARRIVALS[1]}' THEN 2 ELSE 3 END
       + CASE WHEN change_id % 11 = 0 THEN 1 ELSE 0 END AS a FROM {{line_changes}}
""")
_SEEN = ("seen", """
SELECT change_id, ts, a FROM {due} UNION ALL SELECT change_id, ts, a + 1 FROM {due} WHERE change_id % 3 = 0
""")
_MARKS = ("marks", f"""
SELECT k.k, (SELECT max(ts) FROM {{seen}} s WHERE s.a < k.k) - INTERVAL {DELAY_DAYS} DAY AS mark FROM (VALUES (1), (2), (3), (4)) k(k)
""")
_TAKEN = ("taken", """
SELECT d.change_id FROM {due} d JOIN {marks} m ON m.k = d.a WHERE m.mark IS NULL OR d.ts > m.mark
""")
oracle("stream_stock_ledger_late", "SELECT l.* FROM {ledger} l WHERE l.change_id IN (SELECT change_id FROM {taken})",
       [_DUE, _SEEN, _MARKS, _TAKEN, ("ledger", STOCK_LEDGER)])
oracle("stream_append_ledger", STOCK_LEDGER)
oracle("stream_ledger_headers", """
SELECT l.* REPLACE (CASE WHEN reference_id % 7 = 3 THEN NULL ELSE store_id END AS store_id,
                    CASE WHEN reference_id % 7 = 3 THEN NULL ELSE created_by END AS created_by),
       reference_id % 7 = 3 AS waiting
FROM {ledger} l
""", [("ledger", STOCK_LEDGER)])

oracle("load_tables_mixed_sales", """
SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN 'pending' WHEN id % 3 = 0 THEN payment_status END AS payment_status,
                  cast(CASE WHEN id % 2 = 0 THEN 0 WHEN id % 5 = 0 THEN 1 END as decimal(10,2)) AS tax) FROM {sales}
""")

# -- the SQL surface
for _name in ("low_stock", "sales_summary", "inventory_valuation", "product_reviews_summary", "product_inventory"):
    ORACLE[f"sql_{_name}_view"] = ORACLE[_name]
oracle("sql_generate_sales_report", f"""
SELECT cast(s.created_at as date) AS sale_date, p.name AS product_name, cast(sum(si.quantity) as bigint) AS total_quantity,
       cast(sum(si.quantity * si.unit_price) as {MONEY}) AS total_amount
FROM {{sales}} s JOIN {{sale_items}} si ON s.id = si.sale_id JOIN {{products}} p ON si.product_id = p.id
WHERE s.store_id = {STORE} AND cast(s.created_at as date) BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}'
GROUP BY cast(s.created_at as date), p.name
""")
oracle("sql_generate_inventory_report", f"""
SELECT p.name AS product_name, p.quantity, p.price AS unit_price, cast(p.quantity * p.price as {MONEY}) AS total_value,
       CASE WHEN p.quantity < 10 THEN 'Low Stock' WHEN p.quantity = 0 THEN 'Out of Stock' ELSE 'In Stock' END AS stock_status
FROM {{products}} p WHERE p.store_id = {STORE}
""")
