"""Whitening against a plain eigendecomposition of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.llm import whitening as W
from stockroom.llm.queries import queries

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(rows, components=4, scale=256):
    """rows: (vec_id, vector). {(vec_id, component): (n, deviation, |whitened|, explained)}, of distinct ids."""
    usable = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows
              if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(dim)]
    centred = np.array([[float(Fraction(x[k] * n - sums[k], n)) for k in range(dim)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        off = np.array([float(Fraction(a * n - s, n)) for a, s in zip(x, sums)])
        for k in range(min(components, dim)):
            if values[k] > 1e-12 * values.sum():
                out[i, k + 1] = (n, deviation, abs(float(off @ vectors[:, k]) / math.sqrt(values[k])), values[k] / values.sum())
    return out


def check(got, want, close=1e-9):
    assert len(got) == len(want)
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - whitened) <= close * max(1, whitened)
        assert abs(r["explained"] / explained - 1) < 1e-10
        assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("shape", [(3, 1), (40, 3), (5, 64), (400, 12), (300, 30)])
def test_updates_give_the_scatter(shape):
    rng = np.random.default_rng(shape[0])
    for x in (rng.integers(-2, 3, shape).astype(float), rng.normal(0, 40, shape) * np.arange(1, shape[1] + 1)):
        whole, half, other = W.Spectrum(shape[1]), W.Spectrum(shape[1]), W.Spectrum(shape[1])
        for i, row in enumerate(x):
            whole.add(row)
            (half if i < len(x) // 2 else other).add(row)
        half.absorb(W.Spectrum.unpack(other.pack(), shape[1]))
        scatter = (x - x.mean(0)).T @ (x - x.mean(0))
        for s in (whole, half):
            assert np.allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, scatter, atol=1e-11 * max(1, np.trace(scatter)))
            assert np.allclose(s.vectors.T @ s.vectors, np.eye(shape[1]), atol=1e-12)
            assert np.allclose(s.mean, x.mean(0)) and s.n == len(x)


def test_secular_roots_interlace():
    rng = np.random.default_rng(1)
    for k in (1, 2, 9, 64):
        poles = np.cumsum(10.0 ** rng.uniform(-9, 3, k))
        z2 = 10.0 ** rng.uniform(-8, 2, k)
        _, roots = W.secular_roots(poles, z2, 0.7)
        assert (roots > poles).all() and (roots[:-1] < poles[1:]).all()
        want = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(z2), np.sqrt(z2)) / 0.7)
        assert np.allclose(roots, want, rtol=1e-10, atol=1e-13 * poles[-1])


def test_refinement_needs_only_a_rough_start():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(500, 40)) * np.linspace(1, 2, 40)
    cov = a.T @ a / 500
    values, vectors = W.refine(lambda q: cov @ q, rng.normal(size=(40, 8)), 4)
    want, exact = np.linalg.eigh(cov)
    assert np.allclose(values, want[::-1][:4], rtol=1e-12)
    assert np.allclose(np.abs((vectors * exact[:, ::-1][:, :4]).sum(0)), 1, atol=1e-12)


def test_contract(spark, monkeypatch):
    monkeypatch.setattr(W, "ROWS_PER_TASK", 16)  # several levels of combining
    monkeypatch.setattr(W, "FANOUT", 3)
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries()["op13_whitening"](spark, sf)
    assert got.columns == COLUMNS
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    check(got.collect(), plain(rows))


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").select(
        "*", F.lit(1).alias("n"), F.lit("a").alias("x"), F.lit(2).alias("part"))


def test_special_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(c)) for c in rng.normal(0, 3, 5)]) for i in range(30)]
    good += [(100 + i, good[0][1]) for i in range(20)]  # repeats, once in the fit list
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (204, []), (205, [1.0, 2.0])]
    want = plain(good)
    got = W.whiten(_frame(spark, good + bad)).collect()
    check(got, want)
    assert got[0]["n"] == 30
    again = W.whiten(_frame(spark, [(None, v) for _, v in good[:10]] + good[:10])).collect()
    assert sum(r["vec_id"] is None for r in again) == 40 and len(again) == 80


def test_few_components(spark):
    line = [(i, [float(i), 2.0 * i, 0.5]) for i in range(9)]
    got = W.whiten(_frame(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    check(got, plain(line))
    assert W.whiten(_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    none = W.whiten(_frame(spark, []))
    assert none.count() == 0 and none.columns == COLUMNS


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(i, [float(2 ** (20 + i)), float(i), 1.0]) for i in range(4)] + [(9, [0.0, 0.0, float(2**60)])]
    got = {(r["vec_id"], r["component"]): r for r in W.whiten(_frame(spark, rows)).collect()}
    want = plain(rows)
    assert got.keys() <= want.keys() and got
    for k, r in got.items():
        assert r["deviation"] == (want[k][1] if want[k][1] < 2**63 else None)
