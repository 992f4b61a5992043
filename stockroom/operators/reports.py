"""Named reports: the views, the report procedures and the sales report.

The source answers for one store at a time; every operator here answers for
all stores in one pass (``store_id`` is part of the grouping) and takes an
optional ``store_id`` to restrict to one. Fact lines are aggregated to the
report grain *before* dimension joins, so the joins see one row per group,
not one per line, and a hot key is already combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters as flt
from ..functions.money import avg_money, count_rows, line_total, money, sum_money, sum_qty
from ..sources.tables import Tables

LOW_STOCK_THRESHOLD = 10  # fixed value of the source views and procedures


def _store_names(t: Tables) -> DataFrame:
    return t.store.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"))


def low_stock(t: Tables, threshold: int = LOW_STOCK_THRESHOLD) -> DataFrame:
    """Products with quantity below ``threshold``, with their store's name."""
    p = t.products.filter(F.col("quantity") < F.lit(threshold))
    return (p.join(_store_names(t), "store_id", "inner")
            .select("id", "name", "barcode", "quantity", F.col("price").alias("unit_price"),
                    "store_name", "store_id"))


def sales_summary(t: Tables) -> DataFrame:
    """Per sale x day x product: total quantity and amount.

    The source outputs the sale id under the name ``store_id``; we keep that
    grain and output ``sale_id`` and the true ``store_id``.
    """
    lines = (t.sale_items.groupBy("sale_id", "product_id")
             .agg(sum_qty("quantity").alias("total_quantity"),
                  sum_money(line_total()).alias("total_amount")))
    heads = t.sales.select(F.col("id").alias("sale_id"), "store_id",
                           F.to_date("created_at").alias("sale_date"))
    prods = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return (lines.join(heads, "sale_id").join(prods, "product_id").join(_store_names(t), "store_id")
            .select("sale_id", "store_id", "store_name", "sale_date", "product_id", "product_name",
                    "total_quantity", "total_amount"))


def inventory_valuation(t: Tables) -> DataFrame:
    return (t.products.join(_store_names(t), "store_id")
            .select("store_id", "store_name", F.col("id").alias("product_id"),
                    F.col("name").alias("product_name"), "quantity", F.col("price").alias("unit_price"),
                    money(line_total("quantity", "price")).alias("total_value")))


def product_reviews_summary(t: Tables) -> DataFrame:
    """Per product: review count, average/min/max rating; unreviewed products kept."""
    agg = (t.product_reviews.groupBy("product_id")
           .agg(F.count("id").cast("bigint").alias("total_reviews"),
                F.avg("rating").alias("average_rating"),
                F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating")))
    p = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "store_id")
    return (p.join(agg, "product_id", "left").join(_store_names(t), "store_id")
            .select("product_id", "product_name", "store_id", "store_name",
                    F.coalesce("total_reviews", F.lit(0).cast("bigint")).alias("total_reviews"),
                    "average_rating", "min_rating", "max_rating"))


def product_inventory(t: Tables) -> DataFrame:
    return (t.products.join(_store_names(t), "store_id")
            .select(F.col("id").alias("product_id"), F.col("name").alias("product_name"),
                    "price", "quantity", "store_name", "store_id"))


def sales_report_range(t: Tables, start=None, end=None, store_id=None) -> DataFrame:
    """Per store x day x product *name*: quantity and amount, DATE() BETWEEN inclusive.

    Products sharing a name merge into one row, as in the source. Newest day
    first. Without bounds, every day is reported.
    """
    heads = flt.where(t.sales, flt.eq_if("store_id", store_id),
                      None if start is None and end is None else flt.date_between(
                          "created_at", start or "0001-01-01", end or "9999-12-31"))
    heads = heads.select(F.col("id").alias("sale_id"), "store_id", F.to_date("created_at").alias("sale_date"))
    lines = (t.sale_items.join(heads, "sale_id")
             .groupBy("store_id", "sale_date", "product_id")
             .agg(F.sum("quantity").alias("q"), F.sum(line_total()).alias("a")))
    prods = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return (lines.join(prods, "product_id")
            .groupBy("store_id", "sale_date", "product_name")
            .agg(sum_qty("q").alias("total_quantity"), sum_money("a").alias("total_amount"))
            .orderBy(F.col("sale_date").desc_nulls_first(), "store_id", "product_name"))


def inventory_report(t: Tables, store_id=None, threshold: int = LOW_STOCK_THRESHOLD) -> DataFrame:
    """Products with value and stock status, by name.

    The status tests ``< threshold`` before ``= 0`` exactly as the source does,
    so 'Out of Stock' is never produced and a NULL quantity is 'In Stock'.
    """
    p = flt.where(t.products, flt.eq_if("store_id", store_id))
    q = F.col("quantity")
    status = (F.when(q < threshold, "Low Stock").when(q == 0, "Out of Stock").otherwise("In Stock"))
    return (p.select("store_id", F.col("id").alias("product_id"), F.col("name").alias("product_name"),
                     "quantity", F.col("price").alias("unit_price"),
                     money(line_total("quantity", "price")).alias("total_value"),
                     status.alias("stock_status"))
            .orderBy("store_id", "product_name", "product_id"))


def _report_lines(t: Tables, store_id, start, end) -> DataFrame:
    """Sale lines joined to their header, header filters applied before grouping."""
    heads = flt.where(t.sales, flt.eq_if("store_id", store_id), flt.ts_range("created_at", start, end))
    heads = heads.select(F.col("id").alias("sale_id"), "store_id", "created_at")
    return t.sale_items.join(heads, "sale_id")


def sales_report_overall(t: Tables, store_id=None, start=None, end=None) -> DataFrame:
    """Line count, revenue, items and average line amount per store.

    With ``store_id`` given it is a global aggregate (one row even when the
    store sold nothing), as the source's single-store query.
    """
    lines = _report_lines(t, store_id, start, end)
    aggs = [count_rows().alias("total_sales"), sum_money(line_total()).alias("total_revenue"),
            sum_qty("quantity").alias("total_items_sold"),
            avg_money(line_total()).alias("average_sale_amount")]
    if store_id is not None:
        return lines.agg(*aggs).select(F.lit(store_id).cast("bigint").alias("store_id"), "*")
    return lines.groupBy("store_id").agg(*aggs)


def sales_report_by_day(t: Tables, store_id=None, start=None, end=None) -> DataFrame:
    """Per store and calendar day: line count, revenue, items. Newest day first."""
    lines = _report_lines(t, store_id, start, end)
    return (lines.groupBy("store_id", F.to_date("created_at").alias("date"))
            .agg(count_rows().alias("total_sales"), sum_money(line_total()).alias("total_revenue"),
                 sum_qty("quantity").alias("total_items_sold"))
            .orderBy(F.col("date").desc_nulls_first(), "store_id"))


def sales_report_by_product(t: Tables, store_id=None, start=None, end=None) -> DataFrame:
    """Per product (scoped by the *product's* store): distinct sales, quantity, revenue."""
    heads = flt.where(t.sales, flt.ts_range("created_at", start, end)).select(F.col("id").alias("sale_id"))
    per_sale = (t.sale_items.join(heads, "sale_id")
                .groupBy("product_id", "sale_id")
                .agg(F.sum("quantity").alias("q"), F.sum(line_total()).alias("a")))
    prods = flt.where(t.products, flt.eq_if("store_id", store_id)).select(
        F.col("id").alias("product_id"), "name", "store_id")
    return (per_sale.join(prods, "product_id")
            .groupBy("store_id", F.col("product_id").alias("id"), "name")
            .agg(F.count("sale_id").cast("bigint").alias("total_sales"),
                 sum_qty("q").alias("total_quantity_sold"), sum_money("a").alias("total_revenue")))


def sales_report_by_category(t: Tables, store_id=None, start=None, end=None) -> DataFrame:
    """Per category (scoped by the *category's* store); uncategorised products drop."""
    heads = flt.where(t.sales, flt.ts_range("created_at", start, end)).select(F.col("id").alias("sale_id"))
    per_sale = (t.sale_items.join(heads, "sale_id")
                .groupBy("product_id", "sale_id")
                .agg(F.sum("quantity").alias("q"), F.sum(line_total()).alias("a")))
    prods = t.products.filter(F.col("category_id").isNotNull()).select(
        F.col("id").alias("product_id"), "category_id")
    cats = flt.where(t.categories, flt.eq_if("store_id", store_id)).select(
        F.col("id").alias("category_id"), "name", "store_id")
    per_cat_sale = (per_sale.join(prods, "product_id")
                    .groupBy("category_id", "sale_id").agg(F.sum("q").alias("q"), F.sum("a").alias("a")))
    return (per_cat_sale.join(cats, "category_id")
            .groupBy("store_id", F.col("category_id").alias("id"), "name")
            .agg(F.count("sale_id").cast("bigint").alias("total_sales"),
                 sum_qty("q").alias("total_quantity_sold"), sum_money("a").alias("total_revenue")))


def _order_totals(lines: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    tot = lines.groupBy(key).agg(sum_money(line_total()).alias("total_amount"),
                                 count_rows().alias("total_items"))
    return (heads.select(F.col("id").alias(key), "store_id").join(tot, key, "left")
            .select(key, "store_id",
                    F.coalesce("total_amount", F.lit(0).cast("decimal(38,2)")).alias("total_amount"),
                    F.coalesce("total_items", F.lit(0).cast("bigint")).alias("total_items")))


def sale_totals(t: Tables) -> DataFrame:
    """Total per sale (documented procedure); sales without lines total 0."""
    return _order_totals(t.sale_items, t.sales, "sale_id")


def purchase_totals(t: Tables) -> DataFrame:
    return _order_totals(t.purchase_items, t.purchases, "purchase_id")
