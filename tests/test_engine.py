"""The operators against plain NumPy and Python on small series."""

import numpy as np
import pytest

from sysloom.functions import scalars
from sysloom.operators import arx, cleaning, delay, linear, profile, ranks, regressor, selection
from sysloom.operators.errors import SeriesError
from sysloom.operators.regressor import Structure


def frame(spark, columns, series="s"):
    names = list(columns)
    rows = [(series, i, *[None if v is None or np.isnan(v) else float(v) for v in r]) for i, r in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, "series_id string, t long, " + ", ".join(f"{n} double" for n in names))


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


@pytest.fixture(scope="module")
def plant():
    """Two inputs held for a while each, delays 2 and 5."""
    r = np.random.default_rng(3)
    n = 1200
    u1, u2 = np.repeat(r.uniform(-1.5, 1.5, n // 12 + 1), 12)[:n], np.repeat(r.uniform(-1.5, 1.5, n // 18 + 1), 18)[:n]
    y = np.zeros(n)
    for k in range(n):
        y[k] = 1.2 * (y[k - 1] if k else 0) - 0.35 * (y[k - 2] if k > 1 else 0) + (0.4 * u1[k - 2] if k > 1 else 0) + (0.15 * u1[k - 3] if k > 2 else 0) + (0.25 * u2[k - 5] if k > 4 else 0) + (0.1 * u2[k - 6] if k > 5 else 0)
    return {"u1": u1, "u2": u2, "y": y + r.normal(0, 1e-4, n)}


TRUE = Structure(2, {"u1": 2, "u2": 2}, {"u1": 2, "u2": 5})


def test_interpolation(spark):
    v = [np.nan, 1, np.nan, np.nan, 4, np.nan, np.nan, np.nan, 8, np.nan]
    df = frame(spark, {"v": v})
    assert column(cleaning.interpolate(df, "linear", 2), "filled") == [None, 1, 2, 3, 4, None, None, None, 8, None]
    assert column(cleaning.interpolate(df, "ffill", 2), "filled") == [None, 1, 1, 1, 4, None, None, None, 8, 8]
    assert column(cleaning.interpolate(df, "bfill", None), "filled") == [1, 1, 4, 4, 4, 8, 8, 8, 8, None]


def test_hampel_against_a_loop(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=300)
    v[::29] += 9
    v[100:130] = 2.0
    v[110] = 2.5
    v[r.integers(0, 300, 20)] = np.nan
    got = column(cleaning.hampel(frame(spark, {"v": v})), "outlier")
    for k in range(300):
        near = v[max(0, k - 3) : k + 4]
        near = near[~np.isnan(near)]
        if np.isnan(v[k]) or len(near) < 3:
            assert not got[k]
            continue
        m = np.median(near)
        mad = np.median(np.abs(near - m))
        assert got[k] == (abs(v[k] - m) > max(1e-9 * max(abs(v[k]), abs(m)), 1e-12) if mad == 0 else abs(v[k] - m) > 3 * 1.4826 * mad)


def test_savitzky_golay_against_polyfit(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=80)
    v[[5, 6, 40]] = np.nan
    got = column(cleaning.savitzky_golay(frame(spark, {"v": v}), 7), "smoothed")
    for k in range(80):
        x = np.array([j for j in range(-3, 4) if 0 <= k + j < 80 and not np.isnan(v[k + j])])
        if np.isnan(v[k]):
            assert got[k] is None
        else:
            assert abs(got[k] - np.polyval(np.polyfit(x, v[k + x], 2), 0)) < 1e-9


def test_blocks_give_the_same_windows(spark):
    v = np.random.default_rng(2).normal(size=200)
    df = frame(spark, {"v": v})
    whole = cleaning.hampel(df).select("t", "outlier", "local_median")
    cut = cleaning.hampel(cleaning.in_blocks(df, 3, 50), by=["series_id", "block"]).filter("own").select("t", "outlier", "local_median")
    assert sorted(whole.collect()) == sorted(cut.collect())


def test_profile(spark):
    v = [1, 1, 1, 1, 1, np.nan, 1, 2, 100, 3, 2]
    df = frame(spark, {"v": v})
    assert profile.frozen_segments(df).first()[1:] == (0, 4, 5)
    assert profile.longest_missing_run(df).first()[1] == 1
    assert profile.iqr_anomalies(df).first()[1] == 1
    row = profile.quality_profile(df).first()
    assert 0 < row.score < 100 and row.n_frozen == 1


def test_regressor_and_least_squares(spark, plant):
    df = frame(spark, plant)
    rows = regressor.regressor(df, TRUE)
    assert rows.count() == 1200 - TRUE.history and TRUE.history == 6
    got = linear.least_squares(rows, TRUE.features).first()
    x = np.array([[r[c] for c in TRUE.features] for r in rows.collect()])
    y = np.array([r.target for r in rows.collect()])
    assert got.rank == 6 and np.allclose(got.theta, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-9)
    assert np.allclose(got.theta, [-1.2, 0.35, 0.4, 0.15, 0.25, 0.1], atol=0.01)
    ridge = linear.least_squares(rows, TRUE.features, ridge=5.0).first()
    assert np.allclose(ridge.theta, np.linalg.solve(x.T @ x + 5 * np.eye(6), x.T @ y), atol=1e-8)
    twin = rows.withColumn("copy", rows["a1"])
    assert linear.least_squares(twin, [*TRUE.features, "copy"]).first().rank == 6
    with pytest.raises(SeriesError) as e:
        regressor.regressor(df, Structure.of(["nope"]))
    assert e.value.code == "INVALID_DATASET_SCHEMA"


def test_free_run_against_a_loop(spark, plant):
    df = frame(spark, plant)
    models = linear.least_squares(regressor.regressor(df, TRUE), TRUE.features)
    theta = models.first().theta
    got = column(arx.free_run(df, models, TRUE), "simulated")
    sim = plant["y"].copy()
    for k in range(TRUE.history, 1200):
        phi = [-sim[k - 1], -sim[k - 2], plant["u1"][k - 2], plant["u1"][k - 3], plant["u2"][k - 5], plant["u2"][k - 6]]
        sim[k] = np.dot(theta, phi)
    assert np.allclose(got, sim, atol=1e-9)
    fitted = arx.fit(df, TRUE)
    assert min(r.free_run_fit for r in fitted["simulation"].collect()) > 95
    assert {r.input: round(r.gain, 1) for r in fitted["gains"].collect()} == {"u1": 3.7, "u2": 2.3}
    assert arx.stable(theta, 2)[0]


def test_choice_equals_a_naive_greedy(spark, plant):
    rows = regressor.regressor(frame(spark, plant), TRUE)
    got = [r.window for r in selection.informative_windows(regressor.window_rows(rows, 60, 30), TRUE.features, 6).orderBy("rank").collect()]
    x = np.array([[r[c] for c in TRUE.features] for r in rows.orderBy("row").collect()])
    info, naive = 1e-6 * np.eye(6), []
    for _ in range(6):
        gains = {k: np.linalg.slogdet(info + x[30 * k : 30 * k + 60].T @ x[30 * k : 30 * k + 60])[1] for k in range((len(x) - 60) // 30 + 1) if k not in naive}
        best = max(gains, key=lambda k: (round(gains[k], 9), -k))
        naive.append(best)
        info = info + x[30 * best : 30 * best + 60].T @ x[30 * best : 30 * best + 60]
    assert got == naive


def test_delays_are_found(spark, plant):
    df = frame(spark, plant)
    curve = delay.prewhitened(df, "u1", "y", 10, 5)
    n = df.groupBy("series_id").count().withColumnRenamed("count", "n")
    best = delay.peaks(curve, n, 2).filter("rank = 1").first()
    assert abs(best.lag - 2) <= 1
    assert delay.widened([2, 9, 0], 9) == [1, 2, 3, 8, 9, 0] and delay.widened([], 5) == [0]


def test_refined_delays_are_near_the_plants(spark, plant):
    df = frame(spark, plant)
    for most in (400, 1):  # all combinations, and one delay at a time
        got = {r.input: r for r in delay.refined(df, ["u1", "u2"], max_lag=10, max_order=8, most=most).collect()}
        assert abs(got["u1"].delay - 2) <= 1 and abs(got["u2"].delay - 5) <= 1  # inputs held for long hide a step
        assert got["u1"].validation_fit == pytest.approx(delay.refined_fit(plant["y"], {u: plant[u] for u in got}, {u: r.delay for u, r in got.items()}, 2, 2, 720, 960), abs=1e-6)
        assert got["u1"].validation_fit > 95 and not got["u1"].uncertain


def test_delay_score_against_a_loop(plant):
    y, signals = plant["y"], {"u1": plant["u1"], "u2": plant["u2"]}
    for delays in ({"u1": 2, "u2": 5}, {"u1": 0, "u2": 9}, {"u1": 4, "u2": 0}):
        depth = max(2, *(d + 1 for d in delays.values()))
        phi = lambda past, k, delays=delays: [-past[k - 1], -past[k - 2], *(signals[u][k - d - i] for u, d in delays.items() for i in (0, 1))]
        theta = np.linalg.lstsq(np.array([phi(y, k) for k in range(depth, 720)]), y[depth:720], rcond=None)[0]
        sim = y.copy()
        for k in range(720, 960):
            sim[k] = np.dot(theta, phi(sim, k))
        e, own = y[720:960] - sim[720:960], y[720:960]
        want = max(-100, 100 * (1 - np.linalg.norm(e) / np.linalg.norm(own - own.mean())))
        assert delay.refined_fit(y, signals, delays, 2, 2, 720, 960) == pytest.approx(want, abs=1e-6)


def test_ar_models_against_direct_fits(spark):
    r = np.random.default_rng(4)
    x = np.zeros(900)
    for k in range(2, 900):
        x[k] = 0.6 * x[k - 1] - 0.3 * x[k - 2] + r.normal()
    c, best = x - x.mean(), (np.inf, 0, None)
    for p in range(1, 7):
        a, b = np.column_stack([-c[p - k : len(c) - k] for k in range(1, p + 1)]), c[p:]
        theta = np.linalg.lstsq(a, b, rcond=None)[0]
        aic = len(b) * np.log(((b - a @ theta) ** 2).mean()) + 2 * p
        if aic < best[0]:
            best = (aic, p, theta)
    got = delay.ar_models(frame(spark, {"v": x}), "v", 6).first()
    assert got.order == best[1] and np.allclose(got.coefficients, best[2], atol=1e-9)


def test_summary_and_priors(spark, plant):
    fitted = arx.fit(frame(spark, plant), TRUE)
    model, row = fitted["models"].first(), fitted["summary"].first()
    assert row.aic == pytest.approx(model.n * np.log(model.rss / model.n) + 12) and row.bic == pytest.approx(model.n * np.log(model.rss / model.n) + 6 * np.log(model.n))
    assert row.stable and row.max_pole == pytest.approx(0.7, abs=0.01) and 0.5 <= row.whiteness <= 1 and row.fit_gap == pytest.approx(row.one_step_fit - row.free_run_fit)
    broken = arx.violations(fitted, arx.Priors({"u1": "negative", "u2": "positive"}, {"u1": (0, 10), "u2": (0, 1)}, True)).collect()
    assert {(b.variable, b.kind) for b in broken} == {("u1", "gain_sign"), ("u2", "gain_bounds")}
    twin = frame(spark, plant | {"u2": plant["u1"]})
    refused = arx.fit(twin, Structure.of(["u1", "u2"], 2, 2))
    assert refused["refused"].first().reason == "DESIGN_MATRIX_RANK_DEFICIENT" and refused["models"].count() == 0
    assert arx.fit(twin, Structure.of(["u1", "u2"], 2, 2), ridge=0.1)["models"].count() == 1


def test_free_run_starts_anew_in_each_part(spark, plant):
    """The validation fit does not depend on how the run went before the part."""
    df = frame(spark, plant)
    fitted = arx.fit(df, TRUE)
    theta, y = fitted["models"].first().theta, plant["y"]
    start, stop = 720 + TRUE.history, 960 - TRUE.history
    sim = y.copy()
    for k in range(start + 2, stop):
        sim[k] = np.dot(theta, [-sim[k - 1], -sim[k - 2], plant["u1"][k - 2], plant["u1"][k - 3], plant["u2"][k - 5], plant["u2"][k - 6]])
    own = y[start:stop]
    want = 100 * (1 - np.linalg.norm(own - sim[start:stop]) / np.linalg.norm(own - own.mean()))
    got = {r.part: r.free_run_fit for r in fitted["simulation"].collect()}
    assert got["validation"] == pytest.approx(want, abs=1e-6)


def test_rows_stay_within_the_budget(spark):
    r = np.random.default_rng(9)
    spans = [(k, 30 * k, 30 * k + 59) for k in range(20)]
    scores = [(k, float(s)) for k, s in enumerate(r.permutation(20))]
    s = spark.createDataFrame([("s", *x) for x in scores], "series_id string, window long, score double")
    w = spark.createDataFrame([("s", *x) for x in spans], "series_id string, window long, lo long, hi long")
    for budget in (60, 200, 330, 10_000):
        taken, rows = [], set()
        for k, _ in sorted(scores, key=lambda x: (-x[1], x[0])):
            more = rows | set(range(30 * k, 30 * k + 60))
            if len(more) <= budget:
                taken, rows = [*taken, k], more
        assert [x.window for x in regressor.within_rows(s, w, budget).orderBy("rank").collect()] == taken


@pytest.mark.parametrize("n", [0, 1, 700])
def test_positions_and_running_values(spark, n):
    r = np.random.default_rng(2)
    rows = [("ab"[i % 3 == 0], int(k), i, float(v)) for i, (k, v) in enumerate(zip(r.integers(0, 40, n), r.normal(size=n), strict=True))]
    df = spark.createDataFrame(rows, "g string, k long, i long, v double").repartition(3)
    got = {x.i: x.row for x in ranks.positions(df, "g", ["k", "i"]).collect()}
    want = {x[2]: p for g in "ab" for p, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])), 1)}
    assert got == want
    best = {x.i: x.best for x in ranks.running_max(df, "g", "i", "v").collect()}
    assert best == {x[2]: max(y[3] for y in rows if y[0] == x[0] and y[2] <= x[2]) for x in rows}


def test_fingerprint_against_numpy(spark):
    r = np.random.default_rng(5)
    u, w, y = np.cumsum(r.normal(size=400)), r.normal(size=400), np.cumsum(r.normal(size=400))
    u[[3, 50, 51]], y[[7, 300]], y[20] = np.nan, np.nan, 400
    got = profile.fingerprint(frame(spark, {"u": u, "w": w, "y": y}), ["u", "w"], "y").first().features
    f = lambda x: x[~np.isnan(x)]
    own, second = f(y), np.diff(f(y), 2)
    mad = np.median(np.abs(own - np.median(own)))
    sigma = 1.4826 * np.median(np.abs(second - np.median(second))) / 6**0.5
    moving = [np.mean(d > 0.05 * np.percentile(d, 95)) for d in (np.abs(np.diff(f(x))) for x in (u, w))]
    lag1 = lambda x: ((x - x.mean())[:-1] @ (x - x.mean())[1:]) / ((x - x.mean()) @ (x - x.mean()))
    both = ~np.isnan(u)
    want = [np.log10(400) / 6, 0.25, 5 / 1200, np.mean(np.abs(own - np.median(own)) > 3 * 1.4826 * mad), np.clip(10 * np.log10(own.var() / sigma**2) / 60, 0, 1), np.mean(moving), lag1(own), (lag1(f(u)) + lag1(w)) / 2, abs(np.corrcoef(u[both], w[both])[0, 1])]
    assert np.allclose(got, want, atol=1e-9)


def test_number_texts(spark):
    from pyspark.sql import functions as F

    from sysloom.sources.sinks import number

    values = [0.0, 1.0, -2.5, 1234.56789012345, 1e5, 123456789012.3, 1e15, 1e-4, 9.9e-5, -3e-7, 100.0, 0.1 + 0.2, 1 / 3, 2e20]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", number(F.col("x")).alias("g"), scalars.number_text(F.col("x")).alias("t"))
    for r in df.collect():
        assert r.g == f"{r.x:.12g}", r
        plain = f"{r.x:.4e}" if abs(r.x) >= 1e5 or (r.x and abs(r.x) < 1e-4) else f"{r.x:.4f}".rstrip("0").rstrip(".") or "0"
        assert r.t == plain, r
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(scalars.number_text(F.col("x")).alias("t"), number(F.col("x")).alias("g")).collect()
    assert [r.t for r in odd] == ["n/a", "∞", "n/a"] and [odd[0].g, odd[2].g] == ["", ""]
    docs = spark.createDataFrame([('{"a": {"b": [1, {"c": "x"}]}}',)], "j string")
    assert docs.select(scalars.json_at(F.col("j"), "a.b.1.c"), scalars.json_at(F.col("j"), "a..b"), scalars.json_at(F.col("j"), "a.z")).first()[:] == ("x", None, None)


def test_search_agrees_with_direct_fits(spark, plant):
    """Fits, error, white share, poles and worth of each model of the grid, worked out one by one."""
    df = frame(spark, plant)
    trials = {(r.na, r.nb, r.ridge): r for r in arx.search(df, ["u1", "u2"]).collect()}
    assert len(trials) == 24
    y, depth = plant["y"], 4
    for (na, nb, ridge), got in trials.items():
        phi = lambda past, k, na=na, nb=nb: [*(-past[k - i] for i in range(1, na + 1)), *(plant[u][k - i] for u in ("u1", "u2") for i in range(nb))]
        train, held = range(depth, 720 - depth), range(720 + depth, 960 - depth)
        x, t = np.array([phi(y, k) for k in train]), y[train.start : train.stop]
        theta = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ t) if ridge else np.linalg.lstsq(x, t, rcond=None)[0]
        own = y[held.start : held.stop]
        error = own - np.array([phi(y, k) for k in held]) @ theta
        sim = y.copy()
        for k in range(held.start + na, held.stop):
            sim[k] = np.dot(theta, phi(sim, k))
        seen = y[held.start + na : held.stop]
        free = max(-100, 100 * (1 - np.linalg.norm(seen - sim[held.start + na : held.stop]) / np.linalg.norm(seen - seen.mean())))
        ahead = 100 * (1 - np.linalg.norm(error) / np.linalg.norm(own - own.mean()))
        c = error - error.mean()
        white = np.mean([abs(c[:-k] @ c[k:] / (c @ c)) <= 1.96 / len(c) ** 0.5 for k in range(1, 21)])
        rmse, modulus = np.sqrt((error**2).mean()), max(abs(np.roots([1, *theta[:na]])))
        value = 0.45 * np.clip(free / 100, -1, 1) - 0.2 * np.clip(rmse / abs(ahead), 0, 3) - 0.1 * (1 - white) - 0.1 * (na + 2 * nb) / 40 if modulus < 1 else -np.inf
        assert np.allclose([got.free_run_fit, got.one_step_fit, got.rmse, got.whiteness, got.max_pole], [free, ahead, rmse, white, modulus], atol=1e-5), (na, nb, ridge)
        assert got.value == pytest.approx(value, abs=1e-6) and got.stable == (modulus < 1)
    best = arx.best_trials(arx.search(df, ["u1", "u2"])).first()
    assert best.value == pytest.approx(max(r.value for r in trials.values()), abs=1e-9)


def test_correlations_and_groups(spark):
    r = np.random.default_rng(21)
    u1 = r.normal(size=500)
    df = frame(spark, {"u1": u1, "u2": 0.98 * u1 + r.normal(0, 0.05, 500), "u3": r.normal(size=500)})
    links = linear.pearson(df, ["u1", "u2", "u3"])
    assert {(x.a, x.b): x.r for x in links.collect()}["u1", "u2"] == pytest.approx(np.corrcoef(u1, df.toPandas().u2)[0, 1])
    groups = linear.correlation_groups(links)
    assert {x.node: x.grp for x in groups.collect()} == {"u1": "u1", "u2": "u1"}
    vif = {x.name: x.vif for x in linear.inflation(df, ["u1", "u2", "u3"]).collect()}
    assert vif["u1"] > 50 and vif["u3"] < 1.1
    present = spark.createDataFrame([("s", "u1", 499), ("s", "u2", 500), ("s", "u3", 1)], "series_id string, name string, n long")
    assert {x.name: x.action for x in linear.advice(linear.inflation(df, ["u1", "u2", "u3"]), groups, present).collect()} == {"u1": "drop", "u2": "keep", "u3": "keep"}
    x = df.toPandas()[["u1", "u2", "u3"]]
    s = np.linalg.svd(((x - x.mean()) / x.std(ddof=0)).to_numpy(), compute_uv=False)
    condition = linear.design_condition(df, ["u1", "u2", "u3"])
    assert condition.first().condition == pytest.approx(s[0] / s[-1])
    none = groups.limit(0)
    advised = linear.advice(linear.inflation(df, ["u1", "u2", "u3"]), none, present, condition=condition).collect()
    assert {x.name: x.action for x in advised} == {"u1": "review", "u2": "review", "u3": "keep", "__design__": "review"}


def test_excitation_orders(spark):
    step = np.zeros(3000)
    step[1500:] = 1
    cases = {"noise": (np.random.default_rng(11).normal(size=400), 6), "step": (step, 1), "zeros": (np.zeros(400), 0)}
    for name, (v, order) in cases.items():
        assert linear.excitation_orders(frame(spark, {"v": v}, name), "v", 6).first().pe_order == order, name


def test_keys_do_not_depend_on_order():
    a = scalars.step_key("p", "clean", "1", {"x": 1.0000000001, "y": [float("nan"), 2]})
    assert a == scalars.step_key("p", "clean", "1", {"y": [float("nan"), 2], "x": 1.0})
    assert a != scalars.step_key("p", "clean", "2", {"x": 1.0, "y": [float("nan"), 2]})


def test_positions_part_ranges_by_the_whole_order(spark, monkeypatch):
    parts, store = [], ranks.stored
    monkeypatch.setattr(ranks, "stored", lambda df: parts.append(store(df)) or parts[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(8000).selectExpr("'a' AS g", "id % 2 AS k", "id AS i", "id AS rest")
        out = ranks.positions(df, "g", ["k", "i"], columns=["g", "k", "i"])
        assert out.columns == ["g", "k", "i", "row"]
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert all(r.row == (r.i // 2 + 1 if r.k == 0 else 4000 + r.i // 2 + 1) for r in out.collect())
        sizes = [r["count"] for r in parts[0].groupBy("__part").count().collect()]
        assert len(sizes) > 4 and max(sizes) < 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fingerprints_are_one_pass(spark):
    rows = [(s, t, float((t * 7 + t % 3) % 11), float(t % 5), float((t * t) % 13)) for s in (1, 2) for t in range(60)]
    df = spark.createDataFrame(rows, "series_id long, t long, u1 double, u2 double, y double").repartition(5)
    out = profile.fingerprint(df, ["u1", "u2"], "y")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    a, b = (r.features for r in out.orderBy("series_id").collect())
    assert a == b
