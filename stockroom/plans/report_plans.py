"""Registered report queries (§2.2)."""

from __future__ import annotations

from ..operators import reports as R
from .registry import BOUND_END, BOUND_START, RANGE_END, RANGE_START, register

register("low_stock")(lambda t: R.low_stock(t))
register("sales_summary")(lambda t: R.sales_summary(t))
register("inventory_valuation")(lambda t: R.inventory_valuation(t))
register("product_reviews_summary")(lambda t: R.product_reviews_summary(t))
register("product_inventory")(lambda t: R.product_inventory(t))
register("sales_report_range")(lambda t: R.sales_report_range(t, RANGE_START, RANGE_END))
register("inventory_report")(lambda t: R.inventory_report(t))
register("sales_report_overall")(lambda t: R.sales_report_overall(t))
register("sales_report_overall_store")(lambda t: R.sales_report_overall(t, store_id=7))
register("sales_report_by_day")(lambda t: R.sales_report_by_day(t))
register("sales_report_by_day_bounded")(
    lambda t: R.sales_report_by_day(t, start=BOUND_START, end=BOUND_END))
register("sales_report_by_product")(
    lambda t: R.sales_report_by_product(t, start=BOUND_START, end=BOUND_END))
register("sales_report_by_category")(
    lambda t: R.sales_report_by_category(t, start=BOUND_START, end=BOUND_END))
register("sale_totals")(lambda t: R.sale_totals(t))
register("purchase_totals")(lambda t: R.purchase_totals(t))
