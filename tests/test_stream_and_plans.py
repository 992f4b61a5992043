"""Stream = batch (with replays and duplicates), and plan checks."""

import pytest
from pyspark.sql import functions as F

from stockroom.operators.ledger import stock_ledger, stock_on_hand
from stockroom.plans.ledger_plans import changes
from stockroom.session import scratch_dir
from stockroom.sources.changes import write_change_files
from stockroom.streaming import ledger_stream as S


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("n_files,dedupe", [(1, "all"), (3, "all"), (10, "all"), (3, "watermark")])
def test_stream_equals_batch_with_duplicates(spark, t_small, n_files, dedupe):
    ch = changes(t_small)
    base = scratch_dir(spark, "test-stream")
    write_change_files(ch, f"{base}/changes", -(-ch.count() // n_files))
    # a replayed delivery: some records arrive twice, in a later file
    ch.filter(F.col("change_id") % 7 == 0).write.mode("append").parquet(f"{base}/changes")
    S.run_stock_on_hand(spark, f"{base}/changes", f"{base}/out", f"{base}/ckpt", dedupe=dedupe,
                        max_files_per_trigger=2)
    got = S.read_stock_on_hand(spark, f"{base}/out", t_small.products)
    want = stock_on_hand(t_small.products, stock_ledger(ch))
    assert _rows(got) == _rows(want)
    S.run_stock_ledger(spark, f"{base}/changes", f"{base}/ledger", f"{base}/ckpt2", dedupe=dedupe)
    assert _rows(spark.read.parquet(f"{base}/ledger")) == _rows(stock_ledger(ch))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products(spark):
    from stockroom.plans.registry import queries
    q = queries()
    skip = {"post_sales", "post_sales_lines", "post_sales_verdicts", "post_sales_single_line",
            "stream_stock_ledger", "stream_stock_on_hand", "change_stream"}
    # those that run whole batches and read back what was written: a scan is all that is left to plan
    skip |= {n for n in q if n.startswith("stream_") or n.endswith(("_snapshot", "_totals_current"))}
    for name in sorted(set(q) - skip):
        plan = _plan(q[name](spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    from __spark_entry__ import queries
    df = queries()["sales_report_by_day_bounded"](spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    scans = [line for line in plan.splitlines() if "lineitem" in line and "ReadSchema" in line]
    assert scans and all("l_tax" not in s and "l_discount" not in s for s in scans)


def test_compaction_keeps_latest_totals(spark, t_small):
    ch = changes(t_small)
    base = scratch_dir(spark, "test-compact")
    write_change_files(ch, f"{base}/changes", ch.count() // 3)
    S.run_stock_on_hand(spark, f"{base}/changes", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1)
    S.compact_stock_on_hand(spark, f"{base}/out", f"{base}/snap")
    snap = {r["product_id"]: r["movement"] for r in spark.read.parquet(f"{base}/snap").collect()}
    want = {r["product_id"]: r["movement"] for r in stock_on_hand(t_small.products, stock_ledger(ch))
            .filter("movement <> 0").collect()}
    assert {k: v for k, v in snap.items() if v != 0 and k in want} == want


def test_batch_dedupe_and_configure(spark, t_small):
    from stockroom.session import configure
    configure(spark)
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    ch = changes(t_small)
    twice = ch.unionByName(ch.filter(F.col("change_id") % 5 == 0))
    assert _rows(stock_ledger(twice, dedupe=True)) == _rows(stock_ledger(ch))


def test_stream_static_header_join_fills_missing_fields(spark, t_small):
    ch = changes(t_small)
    bare = ch.withColumn("store_id", F.lit(None).cast("bigint")).withColumn("user_id", F.lit(None).cast("bigint"))
    base = scratch_dir(spark, "test-headers")
    write_change_files(bare, f"{base}/changes", ch.count() // 2)
    S.run_stock_ledger(spark, f"{base}/changes", f"{base}/ledger", f"{base}/ckpt",
                       headers=(t_small.sales, t_small.purchases))
    assert _rows(spark.read.parquet(f"{base}/ledger")) == _rows(stock_ledger(ch))


def test_records_without_change_id_stay_in_the_stream(spark, t_small):
    ch = changes(t_small).withColumn("change_id", F.lit(None).cast("bigint"))
    base = scratch_dir(spark, "test-null-ids")
    ch.write.parquet(f"{base}/changes")
    S.run_stock_ledger(spark, f"{base}/changes", f"{base}/ledger", f"{base}/ckpt", dedupe="all")
    assert spark.read.parquet(f"{base}/ledger").count() == stock_ledger(ch).count()


def test_a_corrupt_file_raises(spark, t_small):
    base = scratch_dir(spark, "test-corrupt")
    write_change_files(changes(t_small), f"{base}/changes", 100_000)
    S.run_stock_on_hand(spark, f"{base}/changes", f"{base}/out", f"{base}/ckpt")
    import glob
    path = base.removeprefix("file:")
    victim = sorted(glob.glob(f"{path}/out/batch_id=*/part-*.parquet"))[0]
    with open(victim, "wb") as f:
        f.write(b"not parquet at all, whatever its name says")
    with pytest.raises(Exception):
        S.read_stock_on_hand(spark, f"{base}/out", t_small.products).collect()


def test_nothing_written_is_no_movement(spark, t_small):
    got = S.read_stock_on_hand(spark, scratch_dir(spark, "test-none"), t_small.products)
    assert got.filter("movement <> 0").count() == 0 and got.count() == t_small.products.count()


def test_snapshot_and_newer_batches(spark, t_small):
    ch = changes(t_small)
    base = scratch_dir(spark, "test-newer")
    half = ch.filter("change_id % 2 = 0")
    write_change_files(half, f"{base}/changes", 100_000)
    S.run_stock_on_hand(spark, f"{base}/changes", f"{base}/out", f"{base}/ckpt")
    S.compact_stock_on_hand(spark, f"{base}/out", f"{base}/snap")
    ch.filter("change_id % 2 = 1").write.mode("append").parquet(f"{base}/changes")
    S.run_stock_on_hand(spark, f"{base}/changes", f"{base}/out", f"{base}/ckpt")
    got = S.read_stock_on_hand(spark, f"{base}/out", t_small.products, f"{base}/snap")
    assert _rows(got) == _rows(stock_on_hand(t_small.products, stock_ledger(ch)))
    S.compact_stock_on_hand(spark, f"{base}/out", f"{base}/snap2", f"{base}/snap")
    again = S.read_stock_on_hand(spark, f"{base}/out", t_small.products, f"{base}/snap2")
    assert _rows(again) == _rows(got)


def test_header_filter_reaches_the_lines(spark, t_small):
    from stockroom.operators.listings import list_sales
    plan = list_sales(t_small, store_id=3, payment_method="1-URGENT")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftSemi") < plan.rindex("l_orderkey")
    assert "LeftSemi" not in list_sales(t_small)._jdf.queryExecution().optimizedPlan().toString()
