"""The same rows as some texts of :mod:`stockroom.sources.fixture_sql`, by plans that spread.

Stand-in input as there. DuckDB reads the texts; Spark would join the lines of
``line_changes`` once for every kind of change, and number those of a bulk
request in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Order keys whose lines are numbered together.
ORDER_KEYS = 1_000

_LINE_CHANGES = """
SELECT id * 10 + CASE op WHEN 'I' THEN 1 WHEN 'U' THEN 3 ELSE 2 END AS change_id, '{kind}_items' AS tbl, op,
       id AS line_id, order_id, product_id,
       CASE WHEN op <> 'I' THEN quantity END AS b_quantity, CASE WHEN op <> 'I' THEN unit_price END AS b_unit_price,
       CASE op WHEN 'I' THEN quantity WHEN 'U' THEN quantity + 1 END AS a_quantity,
       cast(CASE op WHEN 'I' THEN unit_price WHEN 'U' THEN {new_price} END as decimal(11,2)) AS a_unit_price,
       store_id, user_id,
       CASE op WHEN 'I' THEN ts WHEN 'U' THEN ts + INTERVAL 12 HOUR ELSE ts + INTERVAL 1 DAY END AS ts
FROM (SELECT l.id, l.{kind}_id AS order_id, l.product_id, l.quantity, l.unit_price, h.store_id, h.user_id,
             h.created_at AS ts,
             explode(CASE WHEN {updated} AND {deleted} THEN array('I', 'U', 'D') WHEN {updated} THEN array('I', 'U')
                          WHEN {deleted} THEN array('I', 'D') ELSE array('I') END) AS op
      FROM {{lines}} l JOIN {{heads}} h ON l.{kind}_id = h.id)
"""


def line_changes(t) -> DataFrame:
    """``line_changes`` with one join of lines and headers per kind of order."""
    def of(kind: str, **parts: str) -> DataFrame:
        return t.spark.sql(_LINE_CHANGES.format(kind=kind, **parts), lines=t[f"{kind}_items"], heads=t[f"{kind}s"])

    sales = of("sale", updated="(h.id % 10 = 2 AND l.id % 3 = 0)", deleted="h.payment_status = 'P'",
               new_price="unit_price")
    return sales.unionByName(of("purchase", updated="(h.id % 10 = 4 AND l.id % 3 = 0)",
                                deleted="h.supplier_id % 10 = 1",
                                new_price="unit_price + cast(1 as decimal(10,2))"))


def bulk_purchase_lines(t) -> DataFrame:
    """``bulk_purchase_lines`` numbered in runs of order keys: a line's place in its run, after those of earlier runs."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    # a header a store
    heads = F.broadcast(t.bulk_purchase_headers.select("request_id", "store_id"))
    lines = t.lineitem.select(*order).join(heads, F.expr("l_orderkey % 25 = store_id"))
    lines = (lines.withColumn("product_id", F.expr("l_partkey - l_partkey % 25 + store_id"))
             .join(t.products.select(F.col("id").alias("product_id")), "product_id")
             .withColumn("_run", F.expr(f"l_orderkey div {ORDER_KEYS}")))
    runs = lines.groupBy("request_id", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("request_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("request_id", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("request_id", "_run").orderBy(*order))
    return (lines.withColumn("_place", place).join(runs, ["request_id", "_run"])
            .select("request_id", (F.col("_before") + F.col("_place")).cast("int").alias("line_no"), "product_id",
                    F.col("l_quantity").cast("int").alias("quantity"),
                    F.col("l_extendedprice").cast("decimal(10,2)").alias("unit_price")))


FRAMES = {"line_changes": line_changes, "bulk_purchase_lines": bulk_purchase_lines}
