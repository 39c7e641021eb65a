"""The cleaning plan and the scans against plain loops over lists."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sysloom.operators import profile, scans
from sysloom.operators.errors import SeriesError
from sysloom.plans import cleanup
from sysloom.plans.cleanup import CHANGED, FILLED, OUTLIER, Cleaning, cleaned

SCHEMA = "series_id string, ord long, ts double, a double, b double, note string"


def loop_fill(v, method, limit):
    out, i = list(v), 0
    while i < len(v):
        j = i
        while j < len(v) and v[j] is None:
            j += 1
        if j > i and (limit is None or j - i <= limit):
            left, right = (v[i - 1] if i else None), (v[j] if j < len(v) else None)
            for k in range(i, j):
                if method == "linear" and left is not None and right is not None:
                    out[k] = left + (right - left) * (k - i + 1) / (j - i + 1)
                elif method == "ffill":
                    out[k] = left
                elif method == "bfill":
                    out[k] = right
        i = max(j, i + 1)
    return out


def loop_outliers(v, p):
    """{index: (centre, lo, hi)}"""
    out = {}
    if p.detector == "hampel":
        h = max(1, p.window // 2)
        for i, x in enumerate(v):
            near = [y for y in v[max(0, i - h) : i + h + 1] if y is not None]
            if x is None or len(near) < 3:
                continue
            m = statistics.median(near)
            mad = statistics.median(abs(y - m) for y in near)
            if mad == 0:
                if not math.isclose(x, m, rel_tol=1e-9, abs_tol=1e-12):
                    out[i] = (m, m, m)
            elif abs(x - m) > p.threshold * 1.4826 * mad:
                out[i] = (m, m - p.threshold * 1.4826 * mad, m + p.threshold * 1.4826 * mad)
        return out
    f = np.array([x for x in v if x is not None])
    if len(f) < 4:
        return out
    if p.detector == "iqr":
        q1, q3 = np.quantile(f, [0.25, 0.75])
        lo, hi, width = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), q3 - q1
    else:
        lo, hi, width = f.mean() - p.z * f.std(ddof=1), f.mean() + p.z * f.std(ddof=1), f.std(ddof=1)
    return {i: (float(np.median(f)), lo, hi) for i, x in enumerate(v) if width and x is not None and (x < lo or x > hi)}


def loop_clean(v, p):
    filled = v if p.interpolation == "none" else loop_fill(v, p.interpolation, p.limit)
    mask = [FILLED * (x is None and y is not None) for x, y in zip(v, filled)]
    found = loop_outliers(filled, p)
    out = list(filled)
    for i, (m, lo, hi) in found.items():
        mask[i] |= OUTLIER
        out[i] = {"keep": out[i], "local_median": m, "clip": min(max(out[i], lo), hi)}.get(p.treatment)
    if p.treatment == "linear_interpolate" and found:
        out = loop_fill(out, "linear" if p.interpolation == "none" else p.interpolation, p.limit)
    for i in range(len(v)):
        if out[i] != filled[i] or p.treatment == "linear_interpolate" and i in found:
            mask[i] |= cleanup.TREATED
    if p.smoothing != "none":
        h, before = (p.smoothing_window | 1) // 2, list(out)
        for i, x in enumerate(before):
            near = [(k - i, before[k]) for k in range(max(0, i - h), min(len(v), i + h + 1)) if before[k] is not None]
            if x is None or len(near) < 3:
                continue
            new = statistics.fmean(y for _, y in near) if p.smoothing == "moving_average" else float(np.polyfit([k for k, _ in near], [y for _, y in near], 2)[-1])
            if not math.isclose(new, x, rel_tol=1e-12, abs_tol=1e-12):
                out[i] = new
                mask[i] |= cleanup.SMOOTHED
    return out, mask


def series(seed, irregular=False):
    """Rows with gaps of many lengths, spikes, steady stretches, repeated times out of order."""
    g, rows, o = random.Random(seed), [], 0
    for name, n in (("p", 150), ("q", 61), ("r", 3), ("one", 1)):
        t = 100.0
        for i in range(n):
            t += g.choice([0.4, 1.0, 1.6, 3.0]) if irregular else 1.0
            for _ in range(2 if g.random() < 0.08 else 1):
                a = None if g.random() < 0.15 or 30 <= i < 30 + seed % 17 else math.sin(i / 9) + g.random() / 5 + (9 if g.random() < 0.05 else 0)
                b = None if i < 4 else float(i // 12) + (g.random() < 0.04) * 5
                rows.append((name, o, t, a, b if g.random() > 0.1 else float("nan"), g.choice([None, "x", "y"])))
                o += 1
    order = list(range(len(rows)))
    g.shuffle(order)
    return [rows[i] for i in order]


def plain(rows, p):
    """{(series, i): (ts, a, b, note, n_rows, masks)} by loops."""
    out = {}
    for name in {r[0] for r in rows}:
        times = {}
        for r in sorted((r for r in rows if r[0] == name), key=lambda r: r[1]):
            times.setdefault(r[2], []).append([None if x is None or isinstance(x, float) and math.isnan(x) else x for x in r])
        num = lambda g, k: (g[0][k] if p.duplicates == "first" else statistics.fmean([x[k] for x in g if x[k] is not None]) if any(x[k] is not None for x in g) else None)
        frame = [(t, num(g, 3), num(g, 4), g[0][5], len(g)) for t, g in sorted(times.items())]
        if p.period:
            t0, n = frame[0][0], int((frame[-1][0] - frame[0][0]) / p.period + 1e-9) + 1
            bins = [[] for _ in range(n)]
            for f in frame:
                k = math.floor((f[0] - t0) / p.period + 0.5)
                if k < n:
                    bins[k].append(f)
            mean = lambda xs: statistics.fmean(xs) if xs else None
            frame = [(t0 + k * p.period, mean([f[1] for f in b if f[1] is not None]), mean([f[2] for f in b if f[2] is not None]), next((f[3] for f in b if f[3] is not None), None), sum(f[4] for f in b)) for k, b in enumerate(bins)]
        a, b = loop_clean([f[1] for f in frame], p), loop_clean([f[2] for f in frame], p)
        for i, f in enumerate(frame):
            out[name, i] = (f[0], a[0][i], b[0][i], f[3], f[4], a[1][i], b[1][i])
    return out


PLANS = [
    Cleaning(),
    Cleaning(limit=2, duplicates="first", treatment="local_median", smoothing="moving_average"),
    Cleaning(limit=None, smoothing="savitzky_golay", smoothing_window=7),
    Cleaning(limit=None, interpolation="ffill", detector="iqr", treatment="clip", period=1.0),
    Cleaning(interpolation="bfill", detector="z_score", z=2.0, treatment="set_null", smoothing="moving_average", smoothing_window=4, period=2.5),
    Cleaning(interpolation="none", detector="iqr", limit=3),
    Cleaning(interpolation="none", limit=None, window=5, threshold=2.0),
    Cleaning(treatment="clip", window=9, threshold=2.5),
    Cleaning(treatment="keep", detector="z_score", duplicates="first", period=0.7, limit=4),
]


@pytest.mark.parametrize("k", range(len(PLANS)))
def test_plan_against_loops(spark, k):
    p, rows = PLANS[k], series(k + 3, irregular=k % 2 == 1)
    want = plain(rows, p)
    got = cleaned(spark.createDataFrame(rows, SCHEMA), ["a", "b"], p, size=16).collect()
    assert len(got) == len(want)
    near = lambda x, y: x is None and y is None or x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    for r in got:
        ts, a, b, note, n, ma, mb = want[r.series_id, r.i]
        assert near(r.ts, ts) and near(r.a, a) and near(r.b, b) and (r.note, r.n_rows, r["a__mask"], r["b__mask"]) == (note, n, ma, mb), (r, want[r.series_id, r.i])
    if p.period is None:
        assert sum(r.n_rows for r in got) == len(rows)


def test_summary_counts_masks_and_bad_parameters_are_refused(spark):
    rows = spark.createDataFrame(series(5), SCHEMA)
    out = cleaned(rows, ["a", "b"], Cleaning())
    cells = out.collect()
    for r in cleanup.summary(out, ["a", "b"]).collect():
        own = [x for x in cells if x.series_id == r.series_id]
        masks = [x[f"{r.column}__mask"] for x in own]
        assert (r.n_filled, r.n_outliers, r.n_changed, r.n_missing) == (sum(bool(m & FILLED) for m in masks), sum(bool(m & OUTLIER) for m in masks), sum(bool(m & CHANGED) for m in masks), sum(x[r.column] is None for x in own))
        assert r.n_duplicates == sum(x.n_rows - 1 for x in own)
    for bad in ({"detector": "guess"}, {"period": 0.0}, {"window": 1}, {"limit": 0}):
        with pytest.raises(SeriesError) as e:
            Cleaning(**bad)
        assert e.value.code == "PARAMETER_OUT_OF_RANGE"
    assert cleaned(rows.limit(0), ["a", "b"]).collect() == []


def test_one_exchange_serves_all_windows(spark):
    """With a limit on gaps and a regular numbering the blocks are dealt once, whatever the number of columns."""
    df = spark.range(500).selectExpr("'s' AS series_id", "id AS ord", "double(id) AS ts", "if(id % 7 = 0, null, double(id % 13)) AS a", "double(id % 5) AS b", "'n' AS note")
    plan = cleaned(df, ["a", "b"], Cleaning(period=1.0, smoothing="moving_average"), size=64)._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "block#" in x]) == 1


def columns(g, n):
    v, i = [], 0
    while len(v) < n:
        v += [None if g.random() < 0.4 else float(g.randint(0, 2))] * g.choice([1, 1, 2, 5, 30])
    return v[:n]


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_scans_equal_windows(spark, size):
    g = random.Random(size)
    rows = [(s, t, v) for s, n in (("a", 200), ("b", 41), ("c", 1)) for t, v in enumerate(columns(g, n))]
    rows += [("d", t, None) for t in range(30)] + [("e", t, 1.0) for t in range(30)]
    df = spark.createDataFrame(rows, "series_id string, t long, v double").cache()
    told = lambda d: sorted(map(tuple, d.collect()))
    assert told(scans.longest_missing_run(df, size=size)) == told(profile.longest_missing_run(df))
    assert told(scans.frozen_segments(df, size=size).select("series_id", "start", "stop", "length")) == told(profile.frozen_segments(df).select("series_id", "start", "stop", "length"))
    from sysloom.operators import cleaning

    for method, limit in (("linear", None), ("ffill", 3), ("bfill", None), ("linear", 2)):
        a = {(r.series_id, r.t): r.v for r in scans.fill(df, ["v"], method, limit, size=size).collect()}
        b = {(r.series_id, r.t): r.filled for r in cleaning.interpolate(df, method, limit).collect()}
        assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or math.isclose(a[k], b[k], abs_tol=1e-12)) for k in a)


def test_a_long_series_is_scanned_in_many_tasks(spark):
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), F.when((F.col("id") % 1000 > 3) & ~F.col("id").between(300_000, 640_000), F.lit(2.0)).alias("v"))
    assert scans.longest_missing_run(df, size=10_000).collect()[0].longest_missing_run == 340_001 + 3
    got = scans.fill(df, ["v"], "linear", 100, size=10_000).agg(F.count_if(F.col("v").isNull()).alias("n")).first().n
    assert got == 340_001 + 3 + 4  # the long gap, and that of the first rows, which have nothing before
