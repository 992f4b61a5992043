"""Far pages against the window, components against a plain search, and order chains decided part by part."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stockroom.functions.components import components
from stockroom.functions.pages import page_of_each
from stockroom.operators import orders as O
from test_post_sales import _both, _one_store, _req


@pytest.mark.parametrize("part", [["g"], []])
def test_far_pages_equal_near_ones(spark, part):
    """A hot group, a NULL group and equal order values; pages at the start, over a group's end and past it."""
    rows = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 < 9, 2).cast("int").alias("g"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 37).alias("x"), F.lit("more").alias("text"))
    order = [F.col("x").desc_nulls_first(), F.col("id")]
    for page_no, limit in [(1, 5), (21, 100), (10_000, 7)]:
        near, far = [sorted(map(repr, page_of_each(rows, part, order, ["x", "id"], page_no, limit, n).collect()))
                     for n in (10**9, 0)]
        assert near == far
    assert page_of_each(rows.limit(0), part, order, ["x", "id"], 3, 5, 0).count() == 0


def test_far_page_ranks_only_the_runs_it_touches(spark):
    """The window of a far page lies on (run, group), so a hot group's rows before the page are not gathered."""
    rows = spark.range(100_000).select("id", F.lit(1).alias("g"))
    page = page_of_each(rows, ["g"], [F.col("id")], ["id"], 9_000, 10)
    assert sorted(r["id"] for r in page.collect()) == list(range(89_990, 90_000))
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_run" in plan


def _plain_components(links):
    label = {}
    for a, b in links:
        for x in (a, b):
            label.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


@pytest.mark.parametrize("links", [
    [(1, 1)], [(7, 3), (3, 7), (3, 3), (9, 7), (4, 5)] + [(20 + i, 21 + i) for i in range(40)]
    + [(100, 100 + i) for i in range(1, 60)] + [(200 + i * 31 % 50, 200 + i * 17 % 50) for i in range(30)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = _plain_components([(a, b) for a, b in links if a != b])
    assert got == want


def test_many_chains_are_decided_in_one_round(spark, t_small, monkeypatch):
    """300 chains of 12 orders, each sharing a product with the next: one round for all parts, in several groups."""
    monkeypatch.setattr(O, "GROUP_ROWS", 1000)
    t = _one_store(spark, t_small, 3900, 1)
    at = dt.datetime(2024, 1, 1)
    rows = [(c * 12 + i + 1, 1, 7, None, "cash", None, at + dt.timedelta(minutes=i),
             [(c * 13 + i + 1, 1, None), (c * 13 + i + 2, 1, None)]) for c in range(300) for i in range(12)]
    assert _both(t, _req(spark, rows)).rounds <= O.SET_ROUNDS + 1


def test_parts_larger_than_a_group(spark, t_small, monkeypatch):
    """Parts beyond the group size give their earliest orders, round by round; random orders beside them."""
    monkeypatch.setattr(O, "GROUP_ROWS", 150)
    t = _one_store(spark, t_small, 200, 2)
    at = dt.datetime(2024, 1, 1)
    rng = random.Random(3)
    rows = [(i, 1, 7, None, "cash", None, at + dt.timedelta(minutes=i // 2), [(i, 1, None), (i + 1, 2, None)])
            for i in range(1, 120)]
    rows += [(i, 1, 7, None, "cash", None, at + dt.timedelta(minutes=rng.randrange(60)),
              [(p, rng.randrange(1, 3), None) for p in rng.sample(range(130, 200), 3)]) for i in range(120, 200)]
    assert _both(t, _req(spark, rows)).rounds > O.SET_ROUNDS
