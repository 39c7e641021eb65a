"""Windows of all sizes from one pass, and the sweeps that rest on them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sysloom.operators import regressor, selection
from sysloom.operators.regressor import Structure
from sysloom.plans import ablation

ONE = Structure.of(["u1", "u2"], 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    r, rows = np.random.default_rng(11), []
    for name, n in (("a", 700), ("b", 431), ("short", 30)):
        u1, u2, y = np.repeat(r.uniform(-1, 1, n // 9 + 1), 9)[:n], np.repeat(r.uniform(-1, 1, n // 13 + 1), 13)[:n], np.zeros(n)
        for k in range(1, n):
            y[k] = 0.7 * y[k - 1] + 0.5 * u1[k] - 0.3 * u2[k] + r.normal(0, 0.02)
        rows += [(name, t, float(u1[t]), float(u2[t]), float(y[t])) for t in range(n)]
    return spark.createDataFrame(rows, "series_id string, t long, u1 double, u2 double, y double").cache()


@pytest.mark.parametrize(("grid", "block"), [([(30, 15), (60, 30), (90, 45)], 2), ([(7, 3), (64, 1)], 5), ([(40, 20)], 512)])
def test_differences_of_running_sums_are_the_windows_products(series, grid, block):
    rows = regressor.regressor(series, ONE).cache()
    x = {k: np.array([[r.a1, r.b_u1_0, r.b_u2_0] for r in rows.filter(F.col("series_id") == k).orderBy("row").collect()]) for k in ("a", "b", "short")}
    got = {(r.series_id, r["size"], r.window): r for r in selection.window_grams(rows, ONE.features, grid, block=block).collect()}
    want = {(k, size, w): (w * stride, w * stride + size) for k, m in x.items() for size, stride in grid for w in range((len(m) - size) // stride + 1) if len(m) >= size}
    assert got.keys() == want.keys()
    for key, (lo, hi) in want.items():
        g = x[key[0]][lo:hi].T @ x[key[0]][lo:hi]
        assert (got[key].lo, got[key].hi) == (lo, hi - 1) and np.allclose(got[key].products, [g[i, j] for i, j in selection.products(ONE.features)], atol=1e-9)


def test_information_of_sums_equals_that_of_rows(series):
    rows = regressor.regressor(series, ONE).cache()
    a = selection.informative_of(selection.window_grams(rows, ONE.features, [(60, 30)]), 3, 6)
    b = selection.informative_windows(regressor.window_rows(rows, 60, 30), ONE.features, 6)
    told = lambda d: sorted((r.series_id, r.rank, r.window, round(r.gain_bits, 6)) for r in d.collect())
    assert told(a) == told(b)


def test_sweep_agrees_with_direct_fits(series):
    """Every cell of the sweep against a direct choice, least squares and free run."""
    got = ablation.sensitivity(series, ONE, (40, 60), (2, 5)).collect()
    assert {(r["size"], r.budget, r.strategy) for r in got if r.series_id == "a"} == {(s, b, k) for s in (40, 60) for b in (2, 5) for k in ("energy", "weighted", "information")} | {(0, 0, "full")}
    d = series.filter("series_id = 'a'").orderBy("t").toPandas()
    u1, u2, y = (d[c].to_numpy() for c in ("u1", "u2", "y"))
    n, a, b = 700, 420, 560
    # the windows of the training part number rows from its first complete one (t = 1)
    phi = np.column_stack([-y[:-1], u1[1:], u2[1:]])
    train = np.arange(0, a - 1)
    for r in got:
        if r.series_id != "a" or r.strategy not in ("energy", "full"):
            continue
        if r.strategy == "full":
            rows = train
        else:
            size, stride = r["size"], r["size"] // 2
            starts = range(0, len(train) - size + 1, stride)
            energy = sorted(starts, key=lambda s: (-round((phi[s : s + size, 1:] ** 2).sum(), 9), s))[: r.budget]
            rows = np.unique(np.concatenate([np.arange(s, s + size) for s in energy]))
        rows = rows[rows + 1 < a - 1]  # steps next to the boundary are in no part
        theta, *_ = np.linalg.lstsq(phi[rows], y[rows + 1], rcond=None)
        sim = y.copy()
        for t in range(a + 2, b - 1):
            sim[t] = theta @ [-sim[t - 1], u1[t], u2[t]]
        own, ran = y[a + 1 : b - 1], sim[a + 1 : b - 1]
        fit = 100 * (1 - np.linalg.norm(own - ran) / np.linalg.norm(own - own.mean()))
        assert r.n_rows == len(rows) and r["rank"] == 3 and math.isclose(r.free_run_fit, fit, abs_tol=1e-6), (r, fit, len(rows))


def test_wins_and_the_self_benchmark(spark, series):
    rows = spark.createDataFrame([("s", 1, 1, "x", 5.0), ("s", 1, 1, "y", 5.0), ("s", 1, 2, "x", None), ("s", 1, 2, "y", 1.0), ("s", 2, 1, "x", None), ("s", 2, 1, "y", None), ("s", 3, 1, "z", None)], "series_id string, size int, budget int, strategy string, free_run_fit double")
    assert sorted(map(tuple, ablation.wins(rows).collect())) == [("s", "x", 1), ("s", "y", 1), ("s", "z", 0)]
    got = {r.series_id: r for r in ablation.self_benchmark(series.filter("series_id <> 'short'"), ONE).collect()}
    assert set(got) == {"a", "b"} and all(r.full_fit > 80 and r.information_fit > 80 and r.discrimination is not None for r in got.values())
