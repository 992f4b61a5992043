"""The source's views as temporary views, for users who write SQL.

``register_views(t)`` defines ``low_stock_view``, ``sales_summary_view``,
``inventory_valuation_view``, ``product_reviews_summary_view`` and
``product_inventory_view`` over the tables of ``t`` (session-scoped, lazy:
nothing runs until a query reads them).
"""

from __future__ import annotations

from ..sources.tables import Tables
from . import reports as R

VIEWS = {
    "low_stock_view": R.low_stock,
    "sales_summary_view": R.sales_summary,
    "inventory_valuation_view": R.inventory_valuation,
    "product_reviews_summary_view": R.product_reviews_summary,
    "product_inventory_view": R.product_inventory,
}


def register_views(t: Tables, prefix: str = "") -> list[str]:
    names = []
    for name, fn in VIEWS.items():
        fn(t).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def register_report_functions(t: Tables, prefix: str = "") -> list[str]:
    """The two report procedures as SQL table functions (session-scoped).

    ``generate_sales_report(store_id, start_date, end_date)`` and
    ``generate_inventory_report(store_id)`` select from temp views of the
    all-store DataFrame operators; Catalyst pushes the parameter filters below
    the aggregation, so a call reads only what it needs.
    """
    spark = t.spark
    R.sales_report_range(t).createOrReplaceTempView(prefix + "sales_report_all")
    R.inventory_report(t).createOrReplaceTempView(prefix + "inventory_report_all")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}generate_sales_report(
            p_store_id BIGINT, p_start_date DATE, p_end_date DATE)
        RETURNS TABLE (sale_date DATE, product_name STRING, total_quantity BIGINT, total_amount DECIMAL(38,2))
        RETURN SELECT sale_date, product_name, total_quantity, total_amount FROM {prefix}sales_report_all
               WHERE store_id = p_store_id AND sale_date BETWEEN p_start_date AND p_end_date
               ORDER BY sale_date DESC""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}generate_inventory_report(p_store_id BIGINT)
        RETURNS TABLE (product_name STRING, quantity INT, unit_price DECIMAL(10,2), total_value DECIMAL(38,2),
                       stock_status STRING)
        RETURN SELECT product_name, quantity, unit_price, total_value, stock_status
               FROM {prefix}inventory_report_all WHERE store_id = p_store_id ORDER BY product_name""")
    return [prefix + "generate_sales_report", prefix + "generate_inventory_report"]
