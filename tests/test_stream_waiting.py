"""Records that wait for their header: tried once in a run, whatever its batches."""

import datetime as dt

from stockroom.session import scratch_dir
from stockroom.sources.changes import LINE_CHANGE
from stockroom.sources.sinks import read_ledger
from stockroom.streaming import ledger_stream as S


def _record(k):
    return (k, "sale_items", "I", None, (k, 100 + k, 7, 2, None), None, None, dt.datetime(2024, 1, 1, 0, k))


def test_waiting_records_are_not_carried_through_every_batch(spark):
    base = scratch_dir(spark, "waiting")
    header = "id long, store_id long, user_id long"

    def run(ids, heads):
        for k in ids:
            spark.createDataFrame([_record(k)], LINE_CHANGE).coalesce(1).write.mode("append").parquet(f"{base}/changes")
        heads = spark.createDataFrame(heads, header)
        S.run_ledger_append(spark, f"{base}/changes", f"{base}/ledger", f"{base}/ckpt", max_files_per_trigger=1,
                            headers=(heads, heads.limit(0)), waiting_path=f"{base}/waiting")

    run([1, 2, 3], [])
    kept = [spark.read.schema(LINE_CHANGE).parquet(f"{base}/waiting/batch_id={n}").count() for n in range(3)]
    assert kept == [1, 1, 1]
    assert sorted(r["change_id"] for r in S.read_waiting(spark, f"{base}/waiting").collect()) == [1, 2, 3]
    run([4, 5], [(101, 1, 1), (103, 1, 1), (105, 1, 1)])
    assert sorted(r["change_id"] for r in S.read_waiting(spark, f"{base}/waiting").collect()) == [2, 4]
    assert sorted(r["change_id"] for r in read_ledger(spark, f"{base}/ledger").collect()) == [1, 3, 5]
    run([6], [(102, 1, 1), (104, 1, 1)])
    assert [r["change_id"] for r in S.read_waiting(spark, f"{base}/waiting").collect()] == [6]
    assert sorted(r["change_id"] for r in read_ledger(spark, f"{base}/ledger").collect()) == [1, 2, 3, 4, 5]
