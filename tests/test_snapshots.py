"""Batch results over stored partitions, and totals kept current, on small tables."""

import datetime as dt
import glob
import os
import shutil
from decimal import Decimal as D

from pyspark.sql import functions as F

from stockroom.operators.totals import current_totals, merge_totals
from stockroom.session import scratch_dir
from stockroom.sources.schemas import TOTALS, evolve_schema
from stockroom.sources.snapshots import Change, apply_batch, read_stored, write_stored
from stockroom.sources.tables import Tables

LINE = "struct<id:long,order_id:long,product_id:long,quantity:int,unit_price:decimal(10,2)>"


def _files(root, name):
    root = root.removeprefix("file:")
    return {p[len(root):]: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/{name}/**/part-*", recursive=True)}


def test_only_touched_partitions_are_written_and_once(spark):
    rows = [(1, 1, "a", 5), (2, 1, "b", 6), (3, 2, "c", 7), (4, 3, "d", 8)]
    products = evolve_schema(spark.createDataFrame(rows, "id long, store_id long, name string, quantity int").coalesce(1), "products")
    root = scratch_dir(spark, "test-snapshot")
    write_stored(Tables(spark, {"products": lambda t: products}), root, ["products"])
    before = _files(root, "products")

    def batch(live):
        new = live.products.filter("id = 1").withColumn("quantity", F.lit(50)).select(*live.products.columns)
        return {"products": Change(new, spark.createDataFrame([(4,)], "id long"))}

    assert apply_batch(spark, root, "b1", ["products"], batch)
    get = lambda: sorted((r["id"], r["store_id"], r["quantity"]) for r in read_stored(spark, root, ["products"]).products.collect())
    want = [(1, 1, 50), (2, 1, 6), (3, 2, 7)]
    assert get() == want
    after = _files(root, "products")
    kept = {p: m for p, m in before.items() if "store_id=2" in p}
    assert kept and kept.items() <= after.items() and not [p for p in after if "store_id=3" in p]
    assert not apply_batch(spark, root, "b1", ["products"], batch) and get() == want

    # a run that ended while the live table was being written: what it left is put right, not computed again
    local = root.removeprefix("file:")
    os.remove(f"{local}/_batches/b1/_done")
    shutil.rmtree(f"{local}/products/store_id=1")
    assert apply_batch(spark, root, "b1", ["products"], lambda live: 1 / 0) and get() == want


def _lines(spark, rows):
    """rows: (change_id, op, line, order, old quantity, new quantity); price 2.00, store 1."""
    at = dt.datetime(2024, 1, 1)
    image = lambda line, order, q: None if q is None else (line, order, 9, q, D("2.00"))
    data = [(c, "sale_items", op, image(i, o, a), image(i, o, b), 1, 7, at + dt.timedelta(days=c // 100))
            for c, op, i, o, a, b in rows]
    return spark.createDataFrame(data, f"change_id long, table string, op string, before {LINE}, after {LINE}, "
                                       "store_id long, user_id long, ts timestamp_ntz")


def _heads(spark, rows):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(c, "sales", op, o, 1, at + dt.timedelta(days=c // 100)) for c, op, o in rows],
                                 "change_id long, tbl string, op string, header_id long, store_id long, ts timestamp_ntz")


def test_totals_follow_changes_and_replays_count_once(spark):
    root = scratch_dir(spark, "test-totals")
    spark.createDataFrame([], TOTALS).write.partitionBy("store_id").parquet(f"{root}/sale_totals")
    came = [(1, "I", 11, 1, None, 3), (2, "I", 12, 1, None, 1), (3, "I", 21, 2, None, 4), (4, "I", 31, 3, None, 1)]
    batches = [
        (_lines(spark, [*came, came[0]]), _heads(spark, [(1, "I", 1), (2, "I", 2), (3, "I", 4)])),
        (_lines(spark, [came[1], (5, "U", 11, 1, 3, 5), (6, "D", 12, 1, 1, None), (7, "D", 21, 2, 4, None), (7, "D", 21, 2, 4, None)]),
         _heads(spark, [(2, "I", 2), (4, "D", 2), (5, "I", 3)]))]
    applied = None
    for k, (lines, heads) in enumerate(batches):
        merged = merge_totals(read_stored(spark, root, ["sale_totals"]).sale_totals, lines, heads, "sale", applied)
        apply_batch(spark, root, f"b{k}", ["sale_totals"], lambda live, m=merged: {"sale_totals": m.change})
        merged.applied.write.parquet(f"{root}/applied/{k}")
        applied = spark.read.parquet(f"{root}/applied/{k}")
    got = sorted(map(tuple, current_totals(read_stored(spark, root, ["sale_totals"]).sale_totals, "sale_id").collect()))
    # order 1: 5 x 2; order 2 is gone; order 3's header came after its line; order 4 has no lines
    assert got == [(1, 1, D("10.00"), 1), (3, 1, D("2.00"), 1), (4, 1, D("0.00"), 0)]


def test_records_before_the_horizon_are_late(spark):
    stored = spark.createDataFrame([], TOTALS)
    seen = spark.createDataFrame([("sale_items", 1, dt.datetime(2024, 1, 1)), ("sale_items", 900, dt.datetime(2024, 1, 10))],
                                 "tbl string, change_id long, ts timestamp_ntz")
    merged = merge_totals(stored, _lines(spark, [(1, "I", 11, 1, None, 3), (2, "I", 12, 1, None, 1), (901, "I", 13, 2, None, 1)]),
                          _heads(spark, []), "sale", seen, "3 DAYS")
    assert [r["id"] for r in merged.change.upserts.collect()] == [2]
    assert [r["change_id"] for r in merged.late.collect()] == [2]
    assert sorted(r["change_id"] for r in merged.applied.collect()) == [900, 901]
