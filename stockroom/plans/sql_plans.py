"""Registered queries that are SQL text over the views and table functions (§2.14)."""

from __future__ import annotations

from ..operators.views import VIEWS, register_report_functions, register_views
from .registry import RANGE_END, RANGE_START, register

STORE = 7


def _view(name: str):
    def run(t):
        register_views(t)
        return t.spark.sql(f"SELECT * FROM {name}")
    return run


def _function(call: str):
    def run(t):
        register_report_functions(t)
        return t.spark.sql(f"SELECT * FROM {call}")
    return run


for _name in VIEWS:
    register(f"sql_{_name}")(_view(_name))
register("sql_generate_sales_report")(
    _function(f"generate_sales_report({STORE}, DATE'{RANGE_START}', DATE'{RANGE_END}')"))
register("sql_generate_inventory_report")(_function(f"generate_inventory_report({STORE})"))
