"""Batches and stored tables that a query reads several times are derived once."""

import pytest
from pyspark.sql import functions as F

from stockroom.operators import orders as O
from stockroom.plans.registry import ops


def _counted(spark, df):
    """``df``, and the number of its rows that were derived so far."""
    n = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b
    return df.mapInArrow(count, df.schema), n


@pytest.mark.parametrize("query, tables", [
    ("post_sales_verdicts", ["sale_request_headers"]),
    ("post_sales_single_line", ["sale_request_headers", "sale_request_lines", "single_sale_request_lines"]),
    ("apply_sale_updates", ["sales", "sale_items"]),
    ("apply_sale_updates_rejects", ["sales", "sale_items"]),
    ("apply_purchase_updates", ["purchases", "purchase_items"]),
])
def test_what_is_read_several_times_is_derived_once(spark, t_small, query, tables):
    counted = {name: _counted(spark, t_small[name]) for name in tables}
    assert ops()[query](t_small.replace(**{name: df for name, (df, _) in counted.items()})).collect()
    assert {name: n.value for name, (_, n) in counted.items()} == {name: t_small[name].count() for name in tables}


def test_request_lines_are_derived_once(spark):
    heads = spark.range(40).select(F.col("id").alias("request_id"))
    lines = spark.range(400).select((F.col("id") % 40).alias("request_id"), F.col("id").alias("line_no"),
                                    F.col("id").alias("product_id"), F.lit(1).alias("quantity"),
                                    F.lit(None).cast("decimal(10,2)").alias("unit_price"))
    df, n = _counted(spark, lines)
    got = O.nest_items(heads, df, "request_id", 3).select("request_id", F.size("items").alias("n")).collect()
    assert sum(r["n"] for r in got) == n.value == 400 and max(r["n"] for r in got) == 3


def test_written_tables_serve_what_is_mapped_from_them(t_small):
    t = t_small.written("sales", "sale_request_headers")
    for name in ("sales", "sale_request_headers", "sale_request_lines"):
        assert t[name].schema.simpleString() == t_small[name].schema.simpleString()
        assert t[name].exceptAll(t_small[name]).isEmpty() and t_small[name].exceptAll(t[name]).isEmpty(), name
    assert all("/stockroom/" in f for n in ("sales", "sale_request_headers") for f in t[n].inputFiles())
    assert any("/sale_request_headers-" in f for f in t.sale_request_lines.inputFiles())
