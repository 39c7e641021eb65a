"""Cleaning of series: gaps, outliers, smoothing. Windows stay within a series; bounded ones can run in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import AT, KEY, iqr_bounds


def in_blocks(df: DataFrame, reach: int, size: int = 100_000, by: str = KEY, at: str = AT) -> DataFrame:
    """``df`` cut into blocks of ``size`` steps, each with ``reach`` steps of its neighbours, for windows that see no further.

    A long series is so shared among tasks. Partition windows by ``(series, block)`` and keep the rows whose
    ``own`` is true. ``at`` must number the steps of a series.
    """
    block = F.floor(F.col(at) / size)
    near = F.sequence(F.floor((F.col(at) - reach) / size), F.floor((F.col(at) + reach) / size))
    return df.withColumn("own_block", block).withColumn("block", F.explode(near)).withColumn("own", F.col("block") == F.col("own_block")).drop("own_block").filter(F.col("block") >= 0)


def interpolate(df: DataFrame, method: str = "linear", limit: int | None = 10, value: str = "v", by: str | list[str] = KEY, at: str = AT) -> DataFrame:
    """``filled``: gaps of at most ``limit`` steps filled by index. Lines need both ends; ``ffill`` and ``bfill`` one.

    What lies ahead is the last value present in falling order, so both directions take one pass each.
    """
    w = Window.partitionBy(by)
    back, ahead = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (at, F.desc(at)))
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(at)))
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).alias("v")))
    rows = rows.withColumns({"__p": F.last(here, True).over(back), "__last": F.count("*").over(w)}).withColumn("__n", F.last(here, True).over(ahead))
    p, n, i = F.col("__p"), F.col("__n"), F.col("__i")
    gap = F.coalesce(n["i"], F.col("__last") + 1) - F.coalesce(p["i"], F.lit(0)) - 1
    fill = {"linear": p["v"] + (n["v"] - p["v"]) * (i - p["i"]) / (n["i"] - p["i"]), "ffill": p["v"], "bfill": n["v"]}[method]
    short = F.lit(True) if limit is None else gap <= limit
    return rows.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).when(short, fill)).drop("__i", "__p", "__n", "__last")


def _median(a: Column) -> Column:
    """Median of an array without nulls; null if it is empty."""
    s = F.array_sort(a)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def hampel(df: DataFrame, window: int = 7, threshold: float = 3.0, value: str = "v", by: str | list[str] = KEY, at: str = AT) -> DataFrame:
    """``outlier``, ``local_median`` and the bounds ``lo`` and ``hi``: off the median of a centred window, cut at the edges, by over
    ``threshold`` scaled deviations.

    Under three values nothing is an outlier; where the deviation is zero anything off the median is.
    """
    half = max(1, window // 2)
    w = Window.partitionBy(by).orderBy(at).rowsBetween(-half, half)
    rows = df.withColumn("near", F.collect_list(value).over(w)).withColumn("local_median", _median(F.col("near")))
    rows = rows.withColumn("mad", _median(F.transform("near", lambda x: F.abs(x - F.col("local_median")))))
    off = F.abs(F.col(value) - F.col("local_median"))
    flat = off > F.greatest(1e-9 * F.greatest(F.abs(F.col(value)), F.abs(F.col("local_median"))), F.lit(1e-12))
    out = F.when(F.col("mad") == 0, flat).otherwise(off > threshold * 1.4826 * F.col("mad"))
    reach = threshold * 1.4826 * F.col("mad")
    rows = rows.withColumns({"outlier": F.coalesce((F.size("near") >= 3) & out, F.lit(False)), "lo": F.col("local_median") - reach, "hi": F.col("local_median") + reach})
    return rows.drop("near", "mad")


def hampel_gate(df: DataFrame, window: int = 11, threshold: float = 3.0, value: str = "v", by: str = KEY, at: str = AT) -> DataFrame:
    """``anomaly``: as ``hampel``, but edges repeat the end values, zero deviation flags nothing, and short series have none."""
    half = window // 2
    w, whole = Window.partitionBy(by).orderBy(at), Window.partitionBy(by)
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, i, n = F.first(value).over(ends), F.last(value).over(ends), F.row_number().over(w), F.count("*").over(whole)
    rows = df.withColumns({"near": F.collect_list(value).over(w.rowsBetween(-half, half)), "first": first, "last": last, "i": i, "n_all": n})
    pad = lambda times, v: F.when((times > 0) & v.isNotNull(), F.array_repeat(v, times)).otherwise(F.array().cast("array<double>"))
    before, after = F.greatest(F.lit(0), half + 1 - F.col("i")), F.greatest(F.lit(0), F.col("i") + half - F.col("n_all"))
    rows = rows.withColumn("near", F.concat("near", pad(before.cast("int"), F.col("first")), pad(after.cast("int"), F.col("last"))))
    rows = rows.withColumn("m", _median(F.col("near"))).withColumn("mad", _median(F.transform("near", lambda x: F.abs(x - F.col("m")))))
    out = (F.col("n_all") >= window) & (F.col("mad") > 0) & (F.abs(F.col(value) - F.col("m")) > threshold * 1.4826 * F.col("mad"))
    return rows.withColumn("anomaly", F.coalesce(out, F.lit(False))).drop("near", "first", "last", "i", "n_all", "m", "mad")


def global_outliers(df: DataFrame, detector: str = "iqr", z: float = 3.0, value: str = "v", by: str = KEY) -> DataFrame:
    """``outlier`` with ``lo`` and ``hi``, bounds over the whole series: whiskers, or ``z`` deviations (n-1) about the mean."""
    if detector == "iqr":
        bounds = iqr_bounds(df, value, by, 0.0)
    else:
        s = df.groupBy(by).agg(F.count(value).alias("m"), F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"))
        ok = (F.col("m") >= 4) & (F.col("sd") > 0)
        bounds = s.select(by, F.when(ok, F.col("mu") - z * F.col("sd")).alias("lo"), F.when(ok, F.col("mu") + z * F.col("sd")).alias("hi"))
    v = F.col(value)
    return df.join(bounds, by).withColumn("outlier", F.coalesce((v < F.col("lo")) | (v > F.col("hi")), F.lit(False)))


def treat(df: DataFrame, strategy: str, value: str = "v", interpolation: str = "linear", limit: int | None = 10, by: str | list[str] = KEY, at: str = AT) -> DataFrame:
    """``treated``: flagged values kept, set to null, put at their local median or bounds, or nulled and every short gap filled."""
    v, bad = F.col(value), F.col("outlier")
    if strategy == "linear_interpolate":
        nulled = df.withColumn("nulled", F.when(~bad, v))
        return interpolate(nulled, interpolation, limit, "nulled", by, at).withColumnRenamed("filled", "treated").drop("nulled")
    value_of = {"keep": v, "set_null": F.when(~bad, v), "local_median": F.when(bad, F.col("local_median")).otherwise(v) if "local_median" in df.columns else v, "clip": F.when(bad, F.least(F.greatest(v, F.col("lo")), F.col("hi"))).otherwise(v) if "lo" in df.columns else v}
    return df.withColumn("treated", value_of[strategy])


def moving_average(df: DataFrame, window: int = 5, value: str = "v", by: str | list[str] = KEY, at: str = AT) -> DataFrame:
    """``smoothed``: mean of a centred window (forced odd) with at least three values; missing values stay missing."""
    half = (window | 1) // 2
    w = Window.partitionBy(by).orderBy(at).rowsBetween(-half, half)
    return df.withColumn("smoothed", F.when(F.col(value).isNotNull(), F.when(F.count(value).over(w) >= 3, F.avg(value).over(w)).otherwise(F.col(value))))


def savitzky_golay(df: DataFrame, window: int = 5, value: str = "v", by: str | list[str] = KEY, at: str = AT) -> DataFrame:
    """``smoothed``: value at the centre of a parabola fitted to the values present in a centred window.

    The normal equations need only windowed sums of powers of the offset, and Cramer's rule solves them.
    """
    half = (window | 1) // 2
    w = Window.partitionBy(by).orderBy(at)
    near = F.array(*[F.struct(F.lit(float(k)).alias("x"), (F.lag(value, -k) if k <= 0 else F.lead(value, k)).over(w).alias("v")) for k in range(-half, half + 1)])
    rows = df.withColumn("near", F.filter(near, lambda p: p["v"].isNotNull()))
    s = [F.aggregate("near", F.lit(0.0), _power_sum(k, False)) for k in range(5)]
    b = [F.aggregate("near", F.lit(0.0), _power_sum(k, True)) for k in range(3)]
    rows = rows.withColumns({f"s{k}": e for k, e in enumerate(s)} | {f"b{k}": e for k, e in enumerate(b)})
    s0, s1, s2, s3, s4, b0, b1, b2 = (F.col(n) for n in ("s0", "s1", "s2", "s3", "s4", "b0", "b1", "b2"))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    top = b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - s3 * b2) + s2 * (b1 * s3 - s2 * b2)
    out = F.when(F.col(value).isNull(), None).when(s0 >= 3, top / det).otherwise(F.col(value))
    return rows.withColumn("smoothed", out).drop("near", "s0", "s1", "s2", "s3", "s4", "b0", "b1", "b2")


def _power_sum(k: int, weighted: bool):
    def step(total: Column, p: Column) -> Column:
        term = F.lit(1.0)
        for _ in range(k):
            term = term * p["x"]
        return total + (term * p["v"] if weighted else term)

    return step


def clean(df: DataFrame, value: str = "v", by: str = KEY, at: str = AT, limit: int = 10, window: int = 7, threshold: float = 3.0) -> DataFrame:
    """Fill short gaps, find outliers by ``hampel``, fill them too. ``cleaned`` with ``changed`` and ``outlier``."""
    filled = interpolate(df, "linear", limit, value, by, at)
    found = hampel(filled, window, threshold, "filled", by, at)
    done = treat(found, "linear_interpolate", "filled", "linear", limit, by, at)
    changed = ~F.col("treated").eqNullSafe(F.col(value))
    return done.withColumn("changed", changed).withColumnRenamed("treated", "cleaned").drop("filled", "local_median", "lo", "hi")
