"""Free runs in blocks equal those step by step."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sysloom.operators import affine, arx
from sysloom.operators.regressor import Structure

S = Structure(3, {"u1": 2, "u2": 1}, {"u1": 2, "u2": 0})


def noisy(spark, n, thetas, seed=1, gap=None):
    r, rows = np.random.default_rng(seed), []
    for name in thetas:
        u1, u2, y = r.normal(size=n), r.normal(size=n), r.normal(size=n)
        rows += [(name, t, None if gap == t else float(u1[t]), float(u2[t]), float(y[t]), "p" if t < n // 2 else None if t < n // 2 + 5 else "q") for t in range(n)]
    df = spark.createDataFrame(rows, "series_id string, t long, u1 double, u2 double, y double, part string").cache()
    return df, spark.createDataFrame(list(thetas.items()), "series_id string, theta array<double>").cache()


def told(df):
    return {(r.series_id, r.t): r.simulated for r in df.collect()}


@pytest.mark.parametrize(("within", "size", "gap"), [(None, 16, None), ("part", 10, None), (None, 7, 120), ("part", 1000, 3)])
def test_blocks_equal_steps(spark, within, size, gap):
    thetas = {"slow": [-1.5, 0.4, 0.12, 0.3, 0.1, -0.2], "swing": [-0.9, 0.95, -0.1, 1.0, 0.0, 0.5], "still": [0.0, 0.0, 0.0, 1.0, 1.0, 1.0], "wild": [-2.5, 0.3, 0.1, 1.0, 1.0, 1.0]}
    df, models = noisy(spark, 203, thetas, gap=gap)
    a, b = told(arx.free_run(df, models, S, within=within)), told(affine.free_run(df, models, S, within=within, size=size))
    assert a.keys() == b.keys()
    for k in a:
        x, y = a[k], b[k]
        assert (x is None or np.isnan(x)) == (y is None or np.isnan(y)), k
        assert x is None or np.isnan(x) or abs(x - y) <= 1e-9 * max(1, abs(x)), (k, x, y)
    assert max(abs(v) for k, v in b.items() if k[0] == "wild" and v == v) > 1000  # the limits were met


def test_companion_powers_move_states_on():
    a, state = [0.3, -0.5, 0.2], [1.0, -2.0, 0.5]
    out, bit = affine.recur([0.0] * 9, a, state, None)
    assert np.allclose(np.linalg.matrix_power(affine.companion(a), 9) @ state, out[-3:]) and not bit
    assert affine.recur([50.0, -50.0], a, state, 10.0) == ([10.0, -10.0], True)


def test_one_long_series_runs_in_many_tasks(spark):
    n = 200_000
    df = spark.range(0, n, 1, 8).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), F.sin(F.col("id") / 50).alias("u1"), F.cos(F.col("id") / 7).alias("u2"), F.sin(F.col("id") / 3).alias("y"))
    models = spark.createDataFrame([("s", [-1.5, 0.4, 0.12, 0.3, 0.1, -0.2])], "series_id string, theta array<double>")
    got = affine.free_run(df, models, S, size=10_000)
    both = got.join(arx.free_run(df, models, S).select("t", F.col("simulated").alias("other")), "t")
    assert both.agg(F.max(F.abs(F.col("simulated") - F.col("other"))).alias("x"), F.count("*").alias("n")).first() == pytest.approx((0, n), abs=1e-9)


def test_no_series(spark):
    df, models = noisy(spark, 10, {"a": [0.1] * 6})
    assert affine.free_run(df.limit(0), models, S).collect() == [] and affine.free_run(df, models.limit(0), S).collect() == []
