"""Benchmark: time the headline queries on one scale factor.

The canonical tables and request batches are first derived from the test
tables and stored as parquet in the shared checkpoint folder (reported as
``stage_sec``) -- the production shape, where operators read stored tables.
Each headline query then runs to completion into the ``noop`` sink (full
execution, no driver collection) on ``local[$BENCH_CPUS]``. Prints one JSON
line; ``value`` is the sum of the query times.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sales_report_by_day", "sales_report_overall", "sales_report_by_product", "sales_report_by_category",
    "sales_summary", "sales_report_range", "product_reviews_summary", "inventory_report",
    "list_sales_all", "list_purchases_all", "sale_documents", "purchase_documents", "list_suppliers",
    "supplier_purchases", "stock_ledger", "stock_on_hand", "stock_reconciliation", "audit_sale_headers",
    "audit_line_rejects", "post_sales", "post_purchases", "apply_sale_updates", "reverse_sales",
    "check_products", "check_store_isolation", "authorize_requests", "stream_stock_on_hand",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from stockroom.session import get_session, scratch_dir
    spark = get_session(f"local[{cpus}]", int(cpus) * 2)
    spark.conf.set("spark.sql.shuffle.partitions", str(int(cpus) * 2))
    from stockroom.plans.registry import ops, tables
    from stockroom.sources.tables import stage_inputs
    t0 = time.time()
    staged = stage_inputs(tables(spark, sf_dir), scratch_dir(spark, "bench-inputs"))
    stage = round(time.time() - t0, 3)
    fns = ops()
    names = [n for n in HEADLINE if n in fns]
    fns["low_stock"](staged).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for n in names:
        t0 = time.time()
        fns[n](staged).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus),
                      "stage_sec": stage}))


if __name__ == "__main__":
    main()
