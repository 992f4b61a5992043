"""DuckDB oracle: for each registered query, an independent SQL statement.

Bodies reference canonical tables as ``{name}``; :func:`sql` prepends the
shared mapping text as CTEs so the oracle reads the same inputs. The bodies
themselves are written from the operator semantics, not from our Spark code.
Output types are pinned (bigint counts, decimal(38,2) money, double
averages) so both engines agree column by column.
"""

from __future__ import annotations

import importlib

from ..sources import fixture_sql
from .registry import BOUND_END, BOUND_START, RANGE_END, RANGE_START

ORACLE: dict[str, str] = {}


def sql(body: str, local: list[tuple[str, str]] | None = None, recursive: bool = False) -> str:
    """Render ``body`` (and optional local CTEs) over the shared mapping."""
    local = local or []
    texts = [body] + [s for _, s in local]
    local_names = {n for n, _ in local}
    refs = sorted({r for s in texts for r in fixture_sql.references(s)} - local_names)
    names = fixture_sql.closure(refs)
    parts = [f"{n} AS ({_conformed(n)})" for n in names]
    parts += [f"{n} AS ({fixture_sql.render(s, 'duckdb').strip()})" for n, s in local]
    head = (("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n") if parts else ""
    return head + fixture_sql.render(body, "duckdb").strip()


def _duck_type(t) -> str:
    from pyspark.sql import types as T
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    return {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.StringType: "VARCHAR",
            T.TimestampNTZType: "TIMESTAMP", T.DateType: "DATE", T.DoubleType: "DOUBLE",
            T.BooleanType: "BOOLEAN"}[type(t)]


def _conformed(name: str) -> str:
    """Mapping text of ``name``; canonical tables get every declared column.

    Input conformance only (typed columns in canonical order, declared
    defaults for columns the mapping does not give), so that ``t.*`` has the
    same columns in both engines.
    """
    from ..sources.schemas import DEFAULTS, SCHEMAS
    body = fixture_sql.render(fixture_sql.MAPPING[name], "duckdb").strip()
    if name not in SCHEMAS:
        return body
    from pyspark.sql import types as T
    given = set()
    for line in fixture_sql.MAPPING[name].split("AS ")[1:]:
        given.add(line.split()[0].strip(",").strip())
    cols = []
    for f in SCHEMAS[name].fields:
        if f.name in given:
            cols.append(f"cast(m.{f.name} as {_duck_type(f.dataType)}) AS {f.name}")
        else:
            d = DEFAULTS.get(name, {}).get(f.name)
            lit = "NULL" if d is None else (f"'{d}'" if isinstance(d, str) else str(d))
            cols.append(f"cast({lit} as {_duck_type(f.dataType)}) AS {f.name}")
    return f"SELECT {', '.join(cols)} FROM ({body}) m"


def oracle(name: str, body: str, local: list[tuple[str, str]] | None = None, recursive: bool = False) -> None:
    ORACLE[name] = sql(body, local, recursive)


MONEY = "decimal(38,2)"

# ---- §2.2 reports ----------------------------------------------------------

oracle("low_stock", """
SELECT p.id, p.name, p.barcode, p.quantity, p.price AS unit_price, s.name AS store_name, s.id AS store_id
FROM {products} p JOIN {store} s ON p.store_id = s.id
WHERE p.quantity < 10
""")

oracle("sales_summary", f"""
SELECT s.id AS sale_id, s.store_id, st.name AS store_name, cast(s.created_at as date) AS sale_date,
       p.id AS product_id, p.name AS product_name,
       cast(sum(si.quantity) as bigint) AS total_quantity,
       cast(sum(si.quantity * si.unit_price) as {MONEY}) AS total_amount
FROM {{sales}} s JOIN {{sale_items}} si ON s.id = si.sale_id
JOIN {{products}} p ON si.product_id = p.id JOIN {{store}} st ON s.store_id = st.id
GROUP BY s.id, s.store_id, st.name, cast(s.created_at as date), p.id, p.name
""")

oracle("inventory_valuation", f"""
SELECT p.store_id, s.name AS store_name, p.id AS product_id, p.name AS product_name, p.quantity,
       p.price AS unit_price, cast(p.quantity * p.price as {MONEY}) AS total_value
FROM {{products}} p JOIN {{store}} s ON p.store_id = s.id
""")

oracle("product_reviews_summary", """
SELECT p.id AS product_id, p.name AS product_name, p.store_id, s.name AS store_name,
       cast(count(pr.id) as bigint) AS total_reviews, avg(pr.rating) AS average_rating,
       min(pr.rating) AS min_rating, max(pr.rating) AS max_rating
FROM {products} p LEFT JOIN {product_reviews} pr ON p.id = pr.product_id
JOIN {store} s ON p.store_id = s.id
GROUP BY p.id, p.name, p.store_id, s.name
""")

oracle("product_inventory", """
SELECT p.id AS product_id, p.name AS product_name, p.price, p.quantity, s.name AS store_name, p.store_id
FROM {products} p JOIN {store} s ON p.store_id = s.id
""")

oracle("sales_report_range", f"""
SELECT s.store_id, cast(s.created_at as date) AS sale_date, p.name AS product_name,
       cast(sum(si.quantity) as bigint) AS total_quantity,
       cast(sum(si.quantity * si.unit_price) as {MONEY}) AS total_amount
FROM {{sales}} s JOIN {{sale_items}} si ON s.id = si.sale_id JOIN {{products}} p ON si.product_id = p.id
WHERE cast(s.created_at as date) BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}'
GROUP BY s.store_id, cast(s.created_at as date), p.name
""")

oracle("inventory_report", f"""
SELECT p.store_id, p.id AS product_id, p.name AS product_name, p.quantity, p.price AS unit_price,
       cast(p.quantity * p.price as {MONEY}) AS total_value,
       CASE WHEN p.quantity < 10 THEN 'Low Stock' WHEN p.quantity = 0 THEN 'Out of Stock'
            ELSE 'In Stock' END AS stock_status
FROM {{products}} p
""")

_OVERALL = f"""cast(count(*) as bigint) AS total_sales,
       cast(sum(si.quantity * si.unit_price) as {MONEY}) AS total_revenue,
       cast(sum(si.quantity) as bigint) AS total_items_sold,
       cast(sum(si.quantity * si.unit_price) as double) / count(si.quantity * si.unit_price)
           AS average_sale_amount"""

oracle("sales_report_overall", f"""
SELECT s.store_id, {_OVERALL}
FROM {{sales}} s JOIN {{sale_items}} si ON s.id = si.sale_id
GROUP BY s.store_id
""")

oracle("sales_report_overall_store", f"""
SELECT cast(7 as bigint) AS store_id, {_OVERALL}
FROM {{sales}} s JOIN {{sale_items}} si ON s.id = si.sale_id
WHERE s.store_id = 7
""")

_BY_DAY = f"""
SELECT s.store_id, cast(s.created_at as date) AS date, cast(count(*) as bigint) AS total_sales,
       cast(sum(si.quantity * si.unit_price) as {MONEY}) AS total_revenue,
       cast(sum(si.quantity) as bigint) AS total_items_sold
FROM {{sales}} s JOIN {{sale_items}} si ON s.id = si.sale_id
WHERE 1 = 1 {{cond}}
GROUP BY s.store_id, cast(s.created_at as date)
"""
oracle("sales_report_by_day", _BY_DAY.replace("{cond}", ""))
oracle("sales_report_by_day_bounded", _BY_DAY.replace(
    "{cond}", f"AND s.created_at >= TIMESTAMP '{BOUND_START} 00:00:00' "
              f"AND s.created_at <= TIMESTAMP '{BOUND_END} 00:00:00'"))

oracle("sales_report_by_product", f"""
SELECT p.store_id, p.id, p.name, cast(count(DISTINCT s.id) as bigint) AS total_sales,
       cast(sum(si.quantity) as bigint) AS total_quantity_sold,
       cast(sum(si.quantity * si.unit_price) as {MONEY}) AS total_revenue
FROM {{products}} p JOIN {{sale_items}} si ON p.id = si.product_id JOIN {{sales}} s ON si.sale_id = s.id
WHERE s.created_at >= TIMESTAMP '{BOUND_START} 00:00:00' AND s.created_at <= TIMESTAMP '{BOUND_END} 00:00:00'
GROUP BY p.store_id, p.id, p.name
""")

oracle("sales_report_by_category", f"""
SELECT c.store_id, c.id, c.name, cast(count(DISTINCT s.id) as bigint) AS total_sales,
       cast(sum(si.quantity) as bigint) AS total_quantity_sold,
       cast(sum(si.quantity * si.unit_price) as {MONEY}) AS total_revenue
FROM {{categories}} c JOIN {{products}} p ON c.id = p.category_id
JOIN {{sale_items}} si ON p.id = si.product_id JOIN {{sales}} s ON si.sale_id = s.id
WHERE s.created_at >= TIMESTAMP '{BOUND_START} 00:00:00' AND s.created_at <= TIMESTAMP '{BOUND_END} 00:00:00'
GROUP BY c.store_id, c.id, c.name
""")

oracle("sale_totals", f"""
SELECT s.id AS sale_id, s.store_id,
       cast(coalesce(sum(si.quantity * si.unit_price), 0) as {MONEY}) AS total_amount,
       cast(count(si.id) as bigint) AS total_items
FROM {{sales}} s LEFT JOIN {{sale_items}} si ON s.id = si.sale_id
GROUP BY s.id, s.store_id
""")

oracle("purchase_totals", f"""
SELECT p.id AS purchase_id, p.store_id,
       cast(coalesce(sum(pi.quantity * pi.unit_price), 0) as {MONEY}) AS total_amount,
       cast(count(pi.id) as bigint) AS total_items
FROM {{purchases}} p LEFT JOIN {{purchase_items}} pi ON p.id = pi.purchase_id
GROUP BY p.id, p.store_id
""")


def _load_all() -> None:
    for mod in ("listing_oracle", "ledger_oracle", "catalog_oracle", "order_oracle",
                "check_oracle", "access_oracle", "snapshot_oracle"):
        importlib.import_module(f"{__package__}.{mod}")


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
