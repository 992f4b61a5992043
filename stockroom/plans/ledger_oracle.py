"""DuckDB oracle text for the ledger queries."""

from __future__ import annotations

from .ledger_plans import AS_OF
from .oracle import oracle
from .source_plans import STORED

_COLS = ("change_id", "store_id", "product_id", "type", "quantity", "unit_price", "created_by",
         "reference_id", "notes", "created_at")


def _entry(change_id, store_id, product_id, typ, qty, price, by, ref, notes, at) -> str:
    return (f"cast({change_id} as bigint) AS change_id, cast({store_id} as bigint) AS store_id, "
            f"cast({product_id} as bigint) AS product_id, cast({typ} as varchar) AS type, "
            f"cast({qty} as int) AS quantity, cast({price} as decimal(10,2)) AS unit_price, "
            f"cast({by} as bigint) AS created_by, cast({ref} as bigint) AS reference_id, "
            f"cast({notes} as varchar) AS notes, cast({at} as timestamp) AS created_at")


def _stock(tbl, op, typ, notes, qty, price) -> str:
    return (f"SELECT {_entry('change_id', 'store_id', 'product_id', repr(typ), qty, price, 'user_id', 'order_id', repr(notes), 'ts')}"
            f" FROM {{line_changes}} WHERE tbl = '{tbl}' AND op = '{op}'")


SALE = _stock("sale_items", "I", "sale", "Sale transaction", "-a_quantity", "a_unit_price")
PURCHASE = _stock("purchase_items", "I", "purchase", "Purchase transaction", "a_quantity", "a_unit_price")
SALE_REV = _stock("sale_items", "D", "sale_reversal", "Sale reversal transaction", "b_quantity", "b_unit_price")
PURCHASE_REV = _stock("purchase_items", "D", "purchase_reversal", "Purchase reversal transaction",
                      "-b_quantity", "b_unit_price")
SALE_ADJ = _stock("sale_items", "U", "sale_adjustment", "Sale line quantity changed",
                  "b_quantity - a_quantity", "a_unit_price")
PURCHASE_ADJ = _stock("purchase_items", "U", "purchase_adjustment", "Purchase line quantity changed",
                      "a_quantity - b_quantity", "a_unit_price")
STOCK_LEDGER = "\nUNION ALL\n".join([SALE, PURCHASE, SALE_REV, PURCHASE_REV, SALE_ADJ, PURCHASE_ADJ])

oracle("ledger_sale", SALE)
oracle("ledger_purchase", PURCHASE)
oracle("ledger_sale_reversal", SALE_REV)
oracle("ledger_purchase_reversal", PURCHASE_REV)
oracle("stock_ledger", STOCK_LEDGER)
oracle("change_stream", """
SELECT change_id, tbl AS "table", op,
       CASE WHEN op IN ('U', 'D') THEN struct_pack(id := line_id, order_id := order_id, product_id := product_id,
            quantity := cast(b_quantity as int), unit_price := cast(b_unit_price as decimal(10,2))) END AS before,
       CASE WHEN op IN ('I', 'U') THEN struct_pack(id := line_id, order_id := order_id, product_id := product_id,
            quantity := cast(a_quantity as int), unit_price := cast(a_unit_price as decimal(10,2))) END AS after,
       store_id, user_id, ts
FROM {line_changes}
""")

_ON_HAND = """
SELECT p.id AS product_id, p.store_id, p.quantity AS opening_quantity,
       cast(coalesce(m.movement, 0) as bigint) AS movement,
       cast(p.quantity + coalesce(m.movement, 0) as bigint) AS quantity_on_hand
FROM {products} p LEFT JOIN (SELECT product_id, sum(quantity) AS movement FROM {ledger}
                             WHERE product_id IS NOT NULL GROUP BY product_id) m ON p.id = m.product_id
"""
oracle("stock_on_hand", _ON_HAND, [("ledger", STOCK_LEDGER)])
oracle("stock_reconciliation", """
SELECT coalesce(s.product_id, e.product_id) AS product_id, s.stored_quantity, e.expected_quantity,
       s.stored_quantity - e.expected_quantity AS difference,
       CASE WHEN s.stored_quantity IS NULL AND e.expected_quantity IS NOT NULL THEN 'missing_stored'
            WHEN e.expected_quantity IS NULL AND s.stored_quantity IS NOT NULL THEN 'missing_expected'
            WHEN s.stored_quantity = e.expected_quantity THEN 'ok'
            WHEN s.stored_quantity IS NULL THEN 'ok' ELSE 'mismatch' END AS status
FROM (SELECT id AS product_id, cast(quantity as bigint) AS stored_quantity FROM {stored}) s
FULL OUTER JOIN (SELECT product_id, quantity_on_hand AS expected_quantity FROM {onhand}) e
  ON s.product_id = e.product_id
""", [("ledger", STOCK_LEDGER), ("onhand", _ON_HAND), ("stored", """
SELECT o.product_id AS id, CASE WHEN o.product_id % 10 = 3 THEN o.quantity_on_hand + 1 ELSE o.quantity_on_hand END AS quantity
FROM {onhand} o WHERE o.product_id % 10 <> 4
UNION ALL SELECT p.id + 10000000, p.quantity FROM {products} p WHERE p.id % 10 = 5
""")])


def _audit_lines(tbl: str, rules: dict) -> str:
    parts = []
    for op, (typ, notes, qty, price) in rules.items():
        parts.append(f"SELECT {_entry('c.change_id', 'c.store_id', 'c.product_id', repr(typ), qty, price, 'c.user_id', 'c.order_id', repr(notes), 'c.ts')}"
                     f" FROM {{line_changes}} c WHERE c.tbl = '{tbl}' AND c.op = '{op}'"
                     f" AND EXISTS (SELECT 1 FROM {{products}} p WHERE p.id = c.product_id AND p.store_id = c.store_id)")
    return "\nUNION ALL\n".join(parts)


oracle("audit_sale_items", _audit_lines("sale_items", {
    "I": ("sale_item_created", "Sale item created", "-c.a_quantity", "c.a_unit_price"),
    "U": ("sale_item_updated", "Sale item updated", "c.b_quantity - c.a_quantity", "c.a_unit_price"),
    "D": ("sale_item_deleted", "Sale item deleted", "c.b_quantity", "c.b_unit_price")}))
oracle("audit_purchase_items", _audit_lines("purchase_items", {
    "I": ("purchase_item_created", "Purchase item created", "c.a_quantity", "c.a_unit_price"),
    "U": ("purchase_item_updated", "Purchase item updated", "c.a_quantity - c.b_quantity", "c.a_unit_price"),
    "D": ("purchase_item_deleted", "Purchase item deleted", "-c.b_quantity", "c.b_unit_price")}))
oracle("audit_line_rejects", """
SELECT c.change_id, c.store_id, c.product_id, 'Product not found' AS reason FROM {line_changes} c
WHERE NOT EXISTS (SELECT 1 FROM {products} p WHERE p.id = c.product_id AND p.store_id = c.store_id)
""")

_H_SALE = ("h", """SELECT *, CASE op WHEN 'I' THEN 'created' WHEN 'U' THEN 'updated' ELSE 'deleted' END AS action
FROM {header_changes} WHERE tbl = 'sales'""")
_BAD_SALE = ("bad", """SELECT DISTINCT h.change_id FROM {h} h JOIN {sale_items} si ON si.sale_id = h.header_id
WHERE h.op = 'U' AND NOT EXISTS (SELECT 1 FROM {products} p WHERE p.id = si.product_id AND p.store_id = h.store_id)""")
oracle("audit_sale_headers", f"""
SELECT {_entry('h.change_id', 'h.store_id', 'NULL', "'sale_' || h.action", 'NULL', 'NULL', 'h.user_id', 'NULL', "'Sale ' || h.action", 'h.ts')}
FROM {{h}} h WHERE h.change_id NOT IN (SELECT change_id FROM {{bad}})
UNION ALL
SELECT {_entry('h.change_id', 'h.store_id', 'si.product_id', "'sale_updated'", '-si.quantity', 'si.unit_price', 'h.user_id', 'h.header_id', "'Sale item'", 'h.ts')}
FROM {{h}} h JOIN {{sale_items}} si ON si.sale_id = h.header_id
WHERE h.op = 'U' AND h.change_id NOT IN (SELECT change_id FROM {{bad}})
""", [_H_SALE, _BAD_SALE])
oracle("audit_sale_header_rejects", """
SELECT h.change_id, h.store_id, cast(NULL as bigint) AS product_id, 'Product not found' AS reason
FROM {h} h WHERE h.change_id IN (SELECT change_id FROM {bad})
""", [_H_SALE, _BAD_SALE])

_H_PUR = ("h", """SELECT c.*, s.name AS supplier_name,
       CASE c.op WHEN 'I' THEN 'created' WHEN 'U' THEN 'updated' ELSE 'deleted' END AS action
FROM {header_changes} c JOIN {suppliers} s ON c.party_id = s.id WHERE c.tbl = 'purchases'""")
_BAD_PUR = ("bad", """SELECT DISTINCT h.change_id FROM {h} h JOIN {purchase_items} pi ON pi.purchase_id = h.header_id
WHERE h.op = 'U' AND NOT EXISTS (SELECT 1 FROM {products} p WHERE p.id = pi.product_id AND p.store_id = h.store_id)""")
oracle("audit_purchase_headers", f"""
SELECT {_entry('h.change_id', 'h.store_id', 'NULL', "'purchase_' || h.action", 'NULL', 'NULL', 'h.user_id', 'NULL', "'Purchase from ' || h.supplier_name || ' ' || h.action", 'h.ts')}
FROM {{h}} h WHERE h.change_id NOT IN (SELECT change_id FROM {{bad}})
UNION ALL
SELECT {_entry('h.change_id', 'h.store_id', 'pi.product_id', "'purchase_updated'", 'pi.quantity', 'pi.unit_price', 'h.user_id', 'h.header_id', "'Purchase item from ' || h.supplier_name", 'h.ts')}
FROM {{h}} h JOIN {{purchase_items}} pi ON pi.purchase_id = h.header_id
WHERE h.op = 'U' AND h.change_id NOT IN (SELECT change_id FROM {{bad}})
""", [_H_PUR, _BAD_PUR])
oracle("audit_purchase_header_rejects", """
SELECT h.change_id, h.store_id, cast(NULL as bigint) AS product_id, 'Product not found' AS reason
FROM {h} h WHERE h.change_id IN (SELECT change_id FROM {bad})
UNION ALL
SELECT c.change_id, c.store_id, cast(NULL as bigint), 'Purchase not found' FROM {header_changes} c
WHERE c.tbl = 'purchases' AND c.party_id NOT IN (SELECT id FROM {suppliers})
""", [_H_PUR, _BAD_PUR])

oracle("audit_suppliers", f"""
SELECT {_entry('change_id', 'store_id', 'NULL', "'supplier_' || a", 'NULL', 'NULL', 'user_id', 'NULL', "'Supplier ' || name || ' ' || a", 'NULL')}
FROM (SELECT *, CASE op WHEN 'I' THEN 'created' WHEN 'U' THEN 'updated' ELSE 'deleted' END AS a
      FROM {{supplier_changes}}) x
""")

oracle("quantity_change_entries", f"""
SELECT {_entry('NULL', 'q.store_id', 'q.product_id', 'q.type', 'q.quantity', 'q.unit_price', 'q.user_id', 'q.reference_id',
               "coalesce(q.notes, 'Product ' || p.name || ' quantity changed by ' || cast(q.quantity as varchar))",
               f"TIMESTAMP '{AS_OF}'")}
FROM {{quantity_changes}} q JOIN {{products}} p ON p.id = q.product_id AND p.store_id = q.store_id
""")
oracle("quantity_change_rejects", """
SELECT q.store_id, q.product_id, 'Product not found' AS reason FROM {quantity_changes} q
WHERE NOT EXISTS (SELECT 1 FROM {products} p WHERE p.id = q.product_id AND p.store_id = q.store_id)
""")
oracle("list_transactions", "SELECT * FROM {ledger} WHERE store_id = 7", [("ledger", STOCK_LEDGER)])
oracle("product_transactions", "SELECT * FROM {ledger} WHERE product_id = 107", [("ledger", STOCK_LEDGER)])

# The streaming keys must equal their batch counterparts.
oracle("stream_stock_ledger", STOCK_LEDGER)
oracle("stream_stock_on_hand", _ON_HAND, [("ledger", STOCK_LEDGER)])

# Sources and sinks: what is read back must equal what went in.
oracle("append_ledger", STOCK_LEDGER)
oracle("load_tables", "SELECT * FROM {products}")
for _name in STORED:
    if _name != "products":
        oracle(f"load_tables_{_name}", f"SELECT * FROM {{{_name}}}")
oracle("load_tables_old_sales", """
SELECT * REPLACE ('pending' AS payment_status, cast(0 as decimal(10,2)) AS discount, cast(0 as decimal(10,2)) AS tax,
                  cast(NULL as timestamp) AS last_updated_at) FROM {sales}
""")
