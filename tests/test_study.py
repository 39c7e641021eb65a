"""Studies: the sampler, trials in batches, and the memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sysloom.operators import arx, profile, regressor, selection
from sysloom.operators.regressor import Structure
from sysloom.plans import study


@pytest.fixture(scope="module")
def plants(spark):
    """Two series whose inputs act three steps late, with spikes and steady stretches."""
    rows = []
    for name, seed in (("a", 3), ("b", 8)):
        g, n = np.random.default_rng(seed), 900
        u1 = np.where(np.arange(n) // 150 % 2 == 0, np.repeat(g.uniform(-1.5, 1.5, n // 13 + 1), 13)[:n], 0.0)
        u2 = np.where(np.arange(n) // 150 % 2 == 0, np.repeat(g.uniform(-1.5, 1.5, n // 19 + 1), 19)[:n], 0.0)
        y = np.zeros(n)
        for k in range(4, n):
            y[k] = 1.35 * y[k - 1] - 0.45 * y[k - 2] + 0.4 * u1[k - 3] + 0.14 * u1[k - 4] + 0.2 * u2[k - 3] + 0.07 * u2[k - 4]
        y += g.normal(0, 0.02, n)
        y[::97] += 4
        rows += [(name, t, float(u1[t]), float(u2[t]), float(y[t])) for t in range(n)]
    return spark.createDataFrame(rows, "series_id string, t long, u1 double, u2 double, y double").cache()


def test_the_sampler_learns_and_stays_on_its_steps():
    values = study.grid()
    sizes = [len(v) for v in values.values()]
    target = [k // 3 for k in sizes]

    def worth(s):
        return -sum(abs(a - b) / k for a, b, k in zip(s, target, sizes, strict=True))

    better = 0
    for seed in range(10):
        tried, even = [], []
        for batch in (10, 10, 10, 10, 10):
            for s in study.ask(tried, sizes, batch, np.random.default_rng([seed, len(tried)])):
                assert all(0 <= x < k for x, k in zip(s, sizes, strict=True))
                tried.append((s, None if s[0] == 0 else worth(s)))
        g = np.random.default_rng(seed)
        even = [worth([int(g.integers(k)) for k in sizes]) for _ in range(40)]
        better += np.mean([x for _, x in tried[10:] if x is not None]) > np.mean(even)
    assert better >= 9
    assert study.ask([], sizes, 3, np.random.default_rng(1)) == study.ask([], sizes, 3, np.random.default_rng(1))
    assert len(study.ask([((0,) * 6, None)] * 30, sizes, 5, np.random.default_rng(1))) == 5
    density = study.parzen([2, 2, 3], 10)
    assert abs(density.sum() - 1) < 1e-12 and density.argmax() == 2 and density.min() > 0


def direct(df, setting, name):
    """One trial by the plain operators."""
    own = df.filter(F.col("series_id") == name)
    part = regressor.chronological(own, 0.0, 0.6)
    rows, size = regressor.regressor(part, Structure.of(["u1", "u2"], 2, 2)), int(setting["window"])
    gate = regressor.Gate(setting["missing"], setting["anomalies"], 0.0, setting["activity"])
    passed = regressor.gate_windows(part, rows, ["u1", "u2"], "y", size, size // 2, gate).filter("accepted").select("series_id", "window")
    held = regressor.window_rows(rows, size, size // 2).join(passed, ["series_id", "window"], "left_semi")
    best = selection.informative_windows(held, Structure.of(["u1", "u2"], 2, 2).features, int(setting["segments"])).select("series_id", "window")
    keep = held.join(best, ["series_id", "window"], "left_semi").select("series_id", "t").distinct()
    late = own.select("series_id", "t", "y", *[F.lag(u, int(setting["nk"])).over(arx.Window.partitionBy("series_id").orderBy("t")).alias(u) for u in ("u1", "u2")])
    return arx.best_trials(arx.search(late, ["u1", "u2"], keep=keep)).collect()


def test_a_batch_equals_trials_one_by_one(spark, plants):
    settings = [("a", 0, 60.0, 6.0, 0.1, 0.1, 0.1, 3.0), ("a", 1, 90.0, 4.0, 0.3, 0.4, 0.02, 0.0), ("b", 0, 200.0, 3.0, 0.3, 0.4, 0.02, 2.0)]
    names = list(study.SPACE)
    hopeless = ("b", 3, 60.0, 5.0, -1.0, 0.1, 0.1, 2.0)  # no window passes
    asked = spark.createDataFrame([*settings, hopeless], "series_id string, study_trial int, " + ", ".join(f"{k} double" for k in names))
    got = {(r.series_id, r.study_trial): r for r in study.evaluated(plants, asked, ["u1", "u2"]).collect()}
    assert len(got) == len(settings) + 1
    for name, trial, *values in settings:
        want, r = direct(plants, dict(zip(names, values, strict=True)), name), got[name, trial]
        if not want:
            assert r.state == "failed" and r.value is None
        else:
            assert r.state == "complete" and (r.na, r.nb, r.ridge) == (want[0].na, want[0].nb, want[0].ridge) and r.value == pytest.approx(want[0].value, abs=1e-9)
    assert got["b", 3].state == "failed" and got["b", 3].value is None and got["a", 0].value > got["a", 1].value


def test_a_study_and_the_next_one_that_starts_from_it(spark, plants, tmp_path):
    rows = study.trials(plants, ["u1", "u2"], 14, batch=4).cache()
    told = rows.collect()
    assert sorted((r.series_id, r.study_trial) for r in told) == [(s, i) for s in "ab" for i in range(14)]
    assert {r.state for r in told} <= {"complete", "pruned", "failed"} and all((r.value is None) == (r.state != "complete") for r in told)
    prints, path = profile.fingerprint(plants, ["u1", "u2"], "y"), str(tmp_path / "memory")
    study.remember(rows, prints, path, "plant-1")
    memory = spark.read.schema(study.MEMORY).parquet(path)
    best = {s: max((r for r in told if r.series_id == s and r.value is not None), key=lambda r: (r.value, -r.study_trial)) for s in "ab"}
    assert {(r.series, r.window, r.nk) for r in memory.collect()} == {(s, r.window, r.nk) for s, r in best.items()}
    assert study.warm_start(prints, memory, "plant-1").count() == 0  # own data never come back
    warm = study.warm_start(prints, memory, "plant-2").cache()
    first = {r.series_id: r for r in warm.filter("place = 0").collect()}
    assert all(first[s].distance == 0 and (first[s].window, first[s].segments, first[s].nk) == (best[s].window, best[s].segments, best[s].nk) for s in "ab")
    asked = study.proposals(plants.select("series_id"), None, 0, 4, warm=warm).collect()
    assert {(r.series_id, r.window, r.nk) for r in asked if r.study_trial == 0} == {(s, r.window, r.nk) for s, r in best.items()} and len(asked) == 8


def test_importance(spark):
    rows = [("s", i, float(i % 5), float(i), float(i) if i != 3 else None) for i in range(12)] + [("few", i, 1.0, 2.0, 3.0) for i in range(3)]
    got = {(r.series_id, r.parameter): r.importance for r in study.importance(spark.createDataFrame(rows, "series_id string, study_trial int, p double, q double, value double"), ["p", "q"]).collect()}
    assert set(got) == {("s", "p"), ("s", "q")} and abs(sum(got.values()) - 1) < 1e-12 and got["s", "q"] > got["s", "p"]
