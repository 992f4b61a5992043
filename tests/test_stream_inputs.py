"""What the streams are fed: read and joined no more often than needed."""

import datetime as dt

from stockroom.functions.lineage import keep
from stockroom.plans.stream_plans import arrivals
from stockroom.sources.changes import LINE_CHANGE


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_meet_their_headers_once_per_kind_of_order(t_small):
    # and orders their customer, purchases their supplier
    assert _plan(t_small.line_changes).count("Join Inner") == 4


def test_an_arrival_reads_the_records_once(spark):
    days = {1: dt.datetime(1994, 1, 1), 2: dt.datetime(1995, 1, 1), 3: dt.datetime(1997, 1, 1)}
    rows = [(100 * due + n, "sale_items", "I", None, None, 1, 1, days[due]) for due in days for n in range(66)]
    rows += [(None, "sale_items", "I", None, None, 1, 1, days[1]), (3, "sale_items", "I", None, None, 1, 1, None)]
    records = keep(spark.createDataFrame(rows, LINE_CHANGE), "records")
    want = {k: [] for k in range(1, 6)}
    for change_id, *_, ts in rows:
        if change_id is not None:
            due = next((k for k, at in days.items() if at == ts), 3) + (change_id % 11 == 0)
            for k in [due, due + 1] if change_id % 3 == 0 else [due]:
                want[k].append(change_id)
    for k, got in arrivals(records):
        assert sorted(r["change_id"] for r in got.collect()) == sorted(want[k])
        assert got.columns == records.columns and _plan(got).count("Relation") == 1
