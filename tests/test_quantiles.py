"""Exact percentiles without a group's values in one buffer."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sysloom.operators import profile, quantiles

SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]


def told(df):
    return {r[0]: r.q for r in df.collect()}


@pytest.mark.parametrize("passes", [1, 2, 3])
def test_equal_to_the_buffered_percentile(spark, passes):
    r, rows = np.random.default_rng(2), []
    for name, x in {
        "normal": r.normal(size=20_000), "tied": r.integers(0, 3, 20_000) * 1.0, "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "few": r.normal(size=7),
        "tails": np.exp(r.normal(0, 30, 9_000)) * r.choice([-1, 1], 9_000), "equal": np.full(5_000, 7.25), "hot": np.where(r.random(20_000) < 0.6, 0.5, r.random(20_000)),
    }.items():
        rows += [(name, float(v)) for v in x]
    rows += [("gaps", None), ("gaps", 3.0), ("gaps", None), ("gaps", 9.0), ("empty", None)]
    df = spark.createDataFrame(rows, "series_id string, v double").repartition(6).cache()
    got = told(quantiles.exact(df, SHARES, passes=passes))
    want = told(df.groupBy("series_id").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")))
    assert got == want


def test_an_erring_sketch_changes_no_result(spark, monkeypatch):
    """Brackets from a sketch of five values, and from none of any width, miss most ranks; counts put them right."""
    x = np.random.default_rng(4).normal(size=3_000)
    df = spark.createDataFrame([("s", float(v)) for v in x], "series_id string, v double").cache()
    want = told(df.groupBy("series_id").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")))
    monkeypatch.setattr(quantiles, "ACCURACY", 5)
    assert told(quantiles.exact(df, SHARES)) == want
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    assert told(quantiles.exact(df, SHARES)) == want


def test_last_window_sorts_a_small_share(spark):
    """Of a million distinct values of one group the brackets keep a few dozen for the sort."""
    df = spark.range(1_000_000).select(F.lit("s").alias("series_id"), (F.xxhash64("id") / 1e6).alias("v")).cache()
    rows = df.select("series_id", F.col("v").alias("__v"))
    brackets = quantiles._brackets(rows, [0.5], "series_id").cache()
    held = quantiles._held(rows, brackets, "series_id").cache()
    assert held.count() < 4_000
    edge = quantiles._narrowed(held, brackets, "series_id").first()
    assert held.filter((F.col("__v") > edge.lo) & (F.col("__v") <= edge.hi)).count() < 200


def test_statistics_and_anomalies_as_with_buffers(spark):
    r = np.random.default_rng(6)
    rows = [(k, None if r.random() < 0.1 else float(v)) for k in "abc" for v in np.append(r.normal(size=500), [40.0, -40.0])]
    rows += [("flat", 1.0)] * 9 + [("none", None), ("three", 1.0), ("three", 2.0), ("three", 90.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "series_id string, v double").cache()
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    named = df.filter("series_id is not null")
    assert same(quantiles.statistics(named), profile.statistics(named)) and same(quantiles.iqr_anomalies(df), profile.iqr_anomalies(df))
    assert {x.series_id for x in quantiles.statistics(df).collect()} == {"a", "b", "c", "flat", "none", "three", None}
    for x in quantiles.robust_spread(named).collect():
        own = np.array([v for k, v in rows if k == x.series_id and v is not None])
        if not len(own):
            assert x.median is None and x.mad is None
        else:
            assert math.isclose(x.median, np.median(own)) and math.isclose(x.mad, np.median(np.abs(own - np.median(own))), abs_tol=1e-12)
    assert quantiles.exact(df.limit(0), [0.5]).collect() == []


def test_rows_of_a_group_stay_where_they_are(spark):
    df = spark.range(2000).selectExpr("if(id % 3 = 0, 'a', 'b') AS series_id", "cast(id % 97 as double) AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quantiles.iqr_anomalies(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(map(tuple, out.collect())) == [("a", 0), ("b", 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_halves_are_rounded_up(spark):
    df = spark.createDataFrame([("a", 52709.74), ("a", 52738.75)], "series_id string, v double")
    assert quantiles.statistics(df, places=2).first().q50 == 52724.25


def test_no_pass_over_the_rows_sorts_them(spark, monkeypatch):
    plans, keep = [], quantiles.kept
    monkeypatch.setattr(quantiles, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    df = spark.range(500).selectExpr("'a' AS series_id", "cast(id as double) AS v")
    assert quantiles.exact(df, [0.5]).first().q == [249.5]
    assert len(plans) >= 4 and "SortAggregate" not in plans[1]
