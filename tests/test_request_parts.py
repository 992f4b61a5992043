"""Posted requests whose lines come in several rows."""

import datetime as dt

from pyspark.sql import functions as F

from stockroom.operators import orders as O
from stockroom.sources.schemas import SCHEMAS
from stockroom.sources.tables import Tables

HEADS = "request_id long, store_id long, user_id long, supplier_id long, notes string, requested_at timestamp_ntz"
LINES = "request_id long, line_no long, product_id long, quantity int, unit_price decimal(10,2)"


def _tables(spark):
    empty = {n: (lambda s: lambda t: t.spark.createDataFrame([], s))(s) for n, s in SCHEMAS.items()}
    t = Tables(spark, empty)
    products = spark.range(1, 8).select("id", F.lit(1).cast("long").alias("store_id"), F.lit(5).alias("quantity"))
    suppliers = spark.range(9, 10).select("id", F.lit(1).cast("long").alias("store_id"))
    return t.replace(products=products, suppliers=suppliers)


def test_a_long_request_is_posted_in_parts(spark):
    at = dt.datetime(2024, 1, 1)
    heads = spark.createDataFrame([(k, 1, 3, 9, None, at) for k in (1, 2, 3, 4, 4)], HEADS)
    lines = [(1, n, n % 7 + 1, n, None) for n in range(1, 12)] + [(2, 5, 1, 1, None), (2, 5, 1, 1, None)]
    lines += [(4, 1, 1, 1, None), (None, 1, 1, 1, None)] + [(3, n, 1 if n < 6 else 70 + n, 1, None) for n in range(9, 2, -1)]
    lines = spark.createDataFrame(lines, LINES)
    parts = O.nest_items(heads, lines, "request_id", 2)
    assert max(len(r["items"]) for r in parts.filter("items IS NOT NULL").collect()) == 2
    t = _tables(spark)
    a, b = (O.post_purchases(r, t) for r in (O.nest_items(heads, lines, "request_id"), parts))
    rows = lambda df: sorted(map(str, df.collect()))
    for of in ("rows", "rejects", "ledger", "extra", "keys"):
        assert rows(getattr(a, of)) == rows(getattr(b, of)), of
    assert dict(b.rejects.collect()) == {3: "Product with ID 76 not found in store", 4: O.SEVERAL}
    assert [(r["id"], r["quantity"]) for r in b.ledger.orderBy("id").collect()][:11] == [(n, n) for n in range(1, 12)]


def test_registered_batches_hold_no_request_whole(t_small):
    from stockroom.plans.order_plans import purchase_requests
    bulk = O.nest_items(t_small.bulk_purchase_headers, t_small.bulk_purchase_lines, "request_id", 50)
    assert bulk.agg(F.max(F.size("items"))).first()[0] == 50
    assert "first_pos" in purchase_requests(t_small).columns


def test_no_task_is_dealt_lines_by_the_request_alone(spark):
    """A request's lines lie in many partitions when they are nested, and when they meet their header."""
    heads = spark.createDataFrame([(1, 1, 3, 9, None, dt.datetime(2024, 1, 1))], HEADS)
    lines = spark.range(1, 20_001).selectExpr("1L AS request_id", "id AS line_no", "id % 7 + 1 AS product_id",
                                              "1 AS quantity", "cast(NULL AS decimal(10,2)) AS unit_price")
    def spread(df):  # every column is asked for, so no join is left out
        rows = df.select(F.spark_partition_id().alias("p"), F.xxhash64(*df.columns).alias("h"))
        return rows.agg(F.count_distinct("p"), F.max("h")).first()[0]

    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for c, v in zip(before, ("false", "-1")):
        spark.conf.set(c, v)
    try:
        parts = O.nest_items(heads, lines, "request_id", 1_000)
        assert spread(parts) > 1
        out = O.post_purchases(parts, _tables(spark))
        assert spread(out.ledger) > 1
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert [r["id"] for r in out.ledger.orderBy("id").select("id").collect()] == list(range(1, 20_001))
    assert out.ledger.filter("product_id <> id % 7 + 1").count() == 0


def test_lines_without_dense_numbers_keep_their_order(spark):
    """Equal, missing and far numbers: the places are those of the sorted lines."""
    heads = spark.createDataFrame([(k, 1, 3, 9, None, dt.datetime(2024, 1, 1)) for k in (1, 2, 3, 4, 5)], HEADS)
    lines = [(1, 7, n, n, None) for n in range(9, 0, -1)] + [(2, None, n, n, None) for n in range(5)]
    lines += [(2, n, n, n, None) for n in (3, 1, 2)] + [(3, 1_000 * n, n, n, None) for n in range(8)]
    lines += [(4, n - 3, n, n, None) for n in range(7)]
    lines = spark.createDataFrame(lines, LINES)
    rows = O._lines(O.nest_items(heads, lines, "request_id", 2), "request_id", []).collect()
    whole = O._lines(O.nest_items(heads, lines, "request_id"), "request_id", []).collect()
    assert sorted(map(str, rows)) == sorted(map(str, whole)) and len(whole) == 32
    assert max(len(r["items"] or []) for r in O.nest_items(heads, lines, "request_id", 2).collect()) <= 2


def test_spread_inputs_give_the_rows_of_their_text(t_small):
    from stockroom.sources.tables import _mapped_builder
    for name in ("bulk_purchase_lines", "line_changes"):
        want, got = _mapped_builder(name)(t_small), t_small[name]
        assert got.dtypes == want.dtypes
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
