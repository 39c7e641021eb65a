"""The choice of windows without a series' windows in one task."""

import numpy as np
import pytest

from sysloom.operators import selection

P = 3


def pool(spark, sizes, seed=1, stride=3, size=10, parts=5):
    r, rows = np.random.default_rng(seed), []
    for name, n in sizes.items():
        for k in range(n):
            x = r.normal(size=(size, P)) * np.exp(r.normal(0, 1.2, P)) if k % 7 else np.ones((size, P))  # equal windows tie
            g = x.T @ x
            rows.append((name, k, k * stride, k * stride + size - 1, [float(g[i, j]) for i, j in selection.products(list(range(P)))]))
    return spark.createDataFrame(rows, "series_id string, window long, lo long, hi long, products array<double>").repartition(parts).cache(), rows


def plainly(rows, **kw):
    out = {}
    for name in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == name}
        grams = {k: selection._square(np.array([r[4]]), P)[0] for k, r in own.items()}
        spans = {k: set(range(r[2], r[3] + 1)) for k, r in own.items()}
        got, _ = selection.greedy(grams, spans, P, kw.get("ridge", 1e-6), kw.get("windows", 10), kw.get("row_budget"), kw.get("least_bits", 0.0))
        out |= {(name, i + 1): (k, g, level) for i, (k, g, level) in enumerate(got)}
    return out


def same(df, want):
    got = {(r.series_id, r["rank"]): (r.window, r.gain_bits * np.log(2), r.log_det) for r in df.collect()}
    assert got.keys() == want.keys()
    for key, (k, g, level) in want.items():
        assert got[key][0] == k and np.allclose(got[key][1:], [g, level], rtol=1e-9, atol=1e-9), (key, got[key], want[key])


@pytest.mark.parametrize("kw", [{"windows": 9}, {"windows": None, "row_budget": 70}, {"windows": None, "least_bits": 2.0}])
@pytest.mark.parametrize("head", [4, 400])
def test_equals_the_choice_in_one_task(spark, kw, head):
    df, rows = pool(spark, {"a": 150, "b": 60, "c": 3, "d": 1})
    same(selection.spread_choice(df, P, head=head, **kw), plainly(rows, **kw))


def test_a_head_of_one_and_all_windows_taken(spark):
    df, rows = pool(spark, {"a": 5, "b": 2}, 3)
    same(selection.spread_choice(df, P, windows=4, head=1), plainly(rows, windows=4))


def test_odd_windows(spark):
    rows = [("a", 1, 0, 9, [1.0, 0.0, 0.0, 1.0, 0.0, 1.0]), ("a", 2, 5, 14, None), ("a", 3, 5, 14, [1.0, None, 0.0, 1.0, 0.0, 1.0]), ("nil", 1, 0, 9, None), ("zero", 1, 0, 9, [0.0] * 6)]
    df = spark.createDataFrame(rows, "series_id string, window long, lo long, hi long, products array<double>")
    assert [(r.series_id, r.window, r["rank"]) for r in selection.spread_choice(df, P).collect()] == [("a", 1, 1)]
    assert selection.spread_choice(df.limit(0), P).collect() == []


def test_many_windows_of_one_series(spark):
    df, rows = pool(spark, {"long": 40_000}, 5, parts=8)
    same(selection.spread_choice(df, P, windows=12, head=50), plainly(rows, windows=12))
