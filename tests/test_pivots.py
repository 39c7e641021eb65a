"""Neighbours by pivots equal those of all pairs, with few pairs compared."""

import numpy as np
import pytest

from sysloom.operators import pivots, profile


def brute(prints, most, top):
    out, names, x = [], [n for n, _ in prints], np.array([f for _, f in prints], float)
    for i, n in enumerate(names):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        best = sorted((round(float(d[j]), 9), names[j]) for j in range(len(names)) if j != i and d[j] <= most)[:top]
        out += [(n, o, v, k + 1) for k, (v, o) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_equal_all_pairs(spark, seed):
    g = np.random.default_rng(seed)
    prints = [(f"s{i:03d}", g.normal(size=9).round(3).tolist()) for i in range(60)]  # far apart
    middle = g.uniform(-0.5, 0.5, 9)
    prints += [(f"t{i:03d}", (middle + 0.02 * g.normal(size=9)).tolist()) for i in range(200)]  # a dense group
    prints += [(f"u{i:03d}", middle.tolist()) for i in range(40)] + [("lone", [9.0] * 9), ("pair", [-9.0] * 9), ("pairs", [-9.0] * 8 + [-8.9])]
    df = spark.createDataFrame(prints, "series_id string, features array<double>")
    compared = []
    got = sorted((r.series_id, r.other, round(r.distance, 9), r["rank"]) for r in pivots.nearest(df, compared=compared).collect())
    assert got == brute(prints, 0.35, 3)
    assert compared and not [r for r in got if r[0] == "lone"]


def test_a_dense_table_compares_few_pairs(spark):
    g = np.random.default_rng(3)
    n, spread = 4000, 0.2
    prints = [(f"s{i:05d}", [*(spread * g.random(3)).tolist(), *[0.5] * 6]) for i in range(n)]  # all within the widest radius of one another
    compared = []
    got = pivots.nearest(spark.createDataFrame(prints, "series_id string, features array<double>"), compared=compared).collect()
    assert len(got) == 3 * n and sum(compared) < n * n / 20
    x, of = np.array([f for _, f in prints]), {}
    for r in got:
        of.setdefault(r.series_id, []).append((round(r.distance, 9), r.other))
    for i in range(0, n, 97):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert sorted(of[prints[i][0]]) == sorted((round(float(d[j]), 9), prints[j][0]) for j in np.argsort(d)[1:4])


def test_empty_and_single(spark):
    df = spark.createDataFrame([("a", [0.0] * 9)], "series_id string, features array<double>")
    assert pivots.nearest(df).collect() == [] and pivots.nearest(df.limit(0)).collect() == []


def test_cells_of_copies_and_dense_tables_compare_few_pairs(spark):
    r = np.random.default_rng(5)
    points = 0.5 + 0.01 * r.normal(size=(1500, 9))
    df = spark.createDataFrame([(i, points[i % 1500].tolist()) for i in range(6000)], "series_id long, features array<double>")
    compared = []
    got = {(x.series_id, x["rank"]): (x.other, round(x.distance, 9)) for x in profile.nearest(df, compared=compared).collect()}
    assert len(got) == 3 * 6000 and sum(compared) < 1500 * 1500
    for i in (0, 77, 5999):
        others = sorted((j for j in range(i % 1500, 6000, 1500) if j != i))
        assert [got[i, k] for k in (1, 2, 3)] == [(j, 0.0) for j in others]
