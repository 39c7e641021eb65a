"""Quality profile of series: everything is aggregates and windows within a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sysloom.functions.scalars import close

KEY, AT = "series_id", "t"


def missing(df: DataFrame, value: str = "v", by: str = KEY) -> DataFrame:
    """Rows, missing values and their rate."""
    gone = F.count_if(F.col(value).isNull())
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), gone.alias("n_missing"), (gone / F.count("*")).alias("missing_rate"))


def runs(df: DataFrame, flag: Column, by: str = KEY, at: str = AT) -> DataFrame:
    """``df`` with ``run``: equal for consecutive rows on which ``flag`` starts no new run."""
    w = Window.partitionBy(by).orderBy(at)
    return df.withColumn("run", F.sum(F.when(flag, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def longest_missing_run(df: DataFrame, value: str = "v", by: str = KEY, at: str = AT) -> DataFrame:
    """Length of the longest run of missing values, 0 without any."""
    marked = runs(df, F.col(value).isNotNull(), by, at)
    lengths = marked.groupBy(by, "run").agg(F.count_if(F.col(value).isNull()).alias("n"))
    return lengths.groupBy(by).agg(F.max("n").alias("longest_missing_run"))


def statistics(df: DataFrame, value: str = "v", by: str = KEY, places: int = 8) -> DataFrame:
    """Count, mean, deviation (n-1; 0 for a single value), range and exact quartiles of the values present."""
    v = F.col(value)
    out = {"mean": F.avg(v), "std": F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)), "min": F.min(v), "max": F.max(v)}
    out |= {f"q{q}": F.percentile(v, F.lit(q / 100)) for q in (25, 50, 75)}
    return df.groupBy(by).agg(F.count(v).alias("n"), *[F.round(e, places).alias(k) for k, e in out.items()])


def iqr_bounds(df: DataFrame, value: str, by: str, tolerance: float) -> DataFrame:
    """Whiskers at one and a half interquartile ranges, null under four values or where the range is at most ``tolerance``."""
    q = df.groupBy(by).agg(F.count(value).alias("m"), F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    ok = (F.col("m") >= 4) & (iqr > tolerance)
    return q.select(by, F.when(ok, F.col("q1") - 1.5 * iqr).alias("lo"), F.when(ok, F.col("q3") + 1.5 * iqr).alias("hi"))


def iqr_anomalies(df: DataFrame, value: str = "v", by: str = KEY) -> DataFrame:
    """Values outside the whiskers; a range of at most 1e-8 counts as none."""
    v = F.col(value)
    return df.join(iqr_bounds(df, value, by, 1e-8), by).groupBy(by).agg(F.count_if((v < F.col("lo")) | (v > F.col("hi"))).alias("n_anomalies"))


def frozen_segments(df: DataFrame, value: str = "v", by: str = KEY, at: str = AT, least: int = 5) -> DataFrame:
    """Longest runs of at least ``least`` consecutive nearly equal values; a missing value ends a run."""
    w = Window.partitionBy(by).orderBy(at)
    same = close(F.col(value), F.lag(value).over(w))
    marked = runs(df, ~F.coalesce(same, F.lit(False)), by, at).filter(F.col(value).isNotNull())
    return marked.groupBy(by, "run").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("run")


def constant(df: DataFrame, value: str = "v", by: str = KEY) -> DataFrame:
    """Whether all values present are equal within 1e-8."""
    return df.groupBy(by).agg(F.coalesce(F.max(value) - F.min(value) <= 1e-8, F.lit(False)).alias("is_constant"))


def intervals(df: DataFrame, ts: str = "ts", by: str = KEY, order: str = "ord") -> DataFrame:
    """Steps between consecutive rows in the order of the file, and the median of the positive ones."""
    w = Window.partitionBy(by).orderBy(order)
    steps = df.select(by, (F.col(ts) - F.lag(ts).over(w)).cast("double").alias("step")).filter("step is not null")
    period = steps.filter("step > 0").groupBy(by).agg(F.percentile("step", F.lit(0.5)).alias("period"))
    return steps.join(period, by, "left")


def irregular_rate(df: DataFrame, ts: str = "ts", by: str = KEY, order: str = "ord") -> DataFrame:
    """Median period, and share of steps that aren't positive or are off the period by over 5 %."""
    off = (F.col("step") <= 0) | (F.abs(F.col("step") - F.col("period")) > F.greatest(0.05 * F.col("period"), F.lit(1e-6)))
    return intervals(df, ts, by, order).groupBy(by).agg(F.max("period").alias("period"), F.avg(F.when(F.coalesce(off, F.lit(True)), 1.0).otherwise(0.0)).alias("irregular_rate"))


def duplicate_timestamps(df: DataFrame, ts: str = "ts", by: str = KEY) -> DataFrame:
    """Rows less distinct times."""
    return df.groupBy(by).agg((F.count("*") - F.countDistinct(ts)).alias("n_duplicates"))


def interval_histogram(df: DataFrame, ts: str = "ts", by: str = KEY, order: str = "ord") -> DataFrame:
    """Counts of steps in at most 12 equal bins, the last closed on the right; one bin if all are equal."""
    steps = intervals(df, ts, by, order)
    span = steps.groupBy(by).agg(F.min("step").alias("lo"), F.max("step").alias("hi"), F.count("*").alias("m"))
    k = F.least(F.lit(12), F.greatest(F.lit(2), F.floor(F.sqrt("m"))))
    span = span.withColumn("k", F.when(F.col("hi") - F.col("lo") <= 1e-8, 1).otherwise(k).cast("int"))
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    bin_ = F.when(F.col("k") == 1, 0).otherwise(F.least(F.col("k") - 1, F.floor((F.col("step") - F.col("lo")) / width).cast("int")))
    return steps.join(span, by).withColumn("bin", bin_).groupBy(by, "bin").agg(F.max(F.round(F.col("lo") + (F.col("bin") + 0.5) * width, 6)).alias("midpoint"), F.count("*").alias("n"))


def quality_score(missing_rate: Column, irregular: Column, duplicates: Column, anomalies: Column, frozen: Column) -> Column:
    """100 less bounded penalties for each kind of fault."""
    return F.greatest(F.lit(0.0), 100.0 - F.least(F.lit(45.0), 200.0 * missing_rate) - F.least(F.lit(20.0), 30.0 * irregular) - F.least(F.lit(15.0), 100.0 * duplicates) - F.least(F.lit(10.0), 100.0 * anomalies) - F.least(F.lit(10.0), 2.0 * frozen))


def quality_profile(df: DataFrame, value: str = "v", by: str = KEY, at: str = AT, order: str | None = None, second: float = 1.0) -> DataFrame:
    """One row a series with all that is known of its quality.

    ``at`` is the time and ``order`` (default ``at``) the order of the file; ``second`` is a second in units of ``at``. Runs, steps
    and repeats come from one window, and two aggregates follow: medians and quartiles, then what is counted against them.
    """
    order = order or at
    w, v = Window.partitionBy(by).orderBy(order), F.col(value)
    rows = df.select(by, v.alias("v"), F.col(at).alias("at"), F.row_number().over(w).alias("i"), (F.col(at) - F.lag(at).over(w)).cast("double").alias("step"), (~F.coalesce(close(v, F.lag(value).over(w)), F.lit(False))).alias("new"))
    so_far = Window.partitionBy(by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    held = F.col("i") - F.last(F.when(F.col("new"), F.col("i")), True).over(so_far) + 1
    gone = F.col("i") - F.coalesce(F.last(F.when(F.col("v").isNotNull(), F.col("i")), True).over(so_far), F.lit(0))
    rows = rows.select(by, "v", "at", "step", F.when(F.col("v").isNotNull(), held).alias("held"), F.when(F.col("v").isNull(), gone).otherwise(0).alias("gone"))
    middle = rows.groupBy(by).agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("v").alias("m"), F.percentile(F.when(F.col("step") > 0, F.col("step")), F.lit(0.5)).alias("period"))
    q = lambda i: F.get("q", i)
    rows = rows.join(middle, by)
    iqr = q(2) - q(0)
    odd = (F.col("m") >= 4) & (iqr > 1e-8) & ((F.col("v") < q(0) - 1.5 * iqr) | (F.col("v") > q(2) + 1.5 * iqr))
    off = (F.col("step") <= 0) | (F.abs(F.col("step") - F.col("period")) > F.greatest(0.05 * F.col("period"), F.lit(1e-6)))
    n, missing_ = F.count("*"), F.count_if(F.col("v").isNull())
    out = rows.groupBy(by).agg(
        n.alias("n_rows"), missing_.alias("n_missing"), (missing_ / n).alias("missing_rate"), F.max("gone").alias("longest_missing_run"), F.count_if(odd).alias("n_anomalies"),
        F.count_if(F.col("held") == 5).alias("n_frozen"), F.coalesce(F.max("v") - F.min("v") <= 1e-8, F.lit(False)).alias("is_constant"), (n - F.countDistinct("at")).alias("n_duplicates"),
        F.coalesce(F.avg(F.when(F.col("step").isNotNull(), F.when(F.coalesce(off, F.lit(True)), 1.0).otherwise(0.0))), F.lit(0.0)).alias("irregular_rate"), (F.max("period") / second).alias("sample_period_seconds"),
        F.min("at").alias("time_start"), F.max("at").alias("time_end"), F.greatest(F.lit(1), F.ceil(n / 10_000)).alias("downsample_factor"),
        F.avg("v").alias("mean"), F.when(F.count("v") == 1, 0.0).otherwise(F.stddev_samp("v")).alias("std"), F.min("v").alias("min"), F.max(q(0)).alias("q25"), F.max(q(1)).alias("q50"), F.max(q(2)).alias("q75"), F.max("v").alias("max"),
    )
    score = quality_score(F.col("missing_rate"), F.col("irregular_rate"), F.col("n_duplicates") / F.col("n_rows"), F.col("n_anomalies") / F.greatest(F.col("n_rows") - F.col("n_missing"), F.lit(1)), F.col("n_frozen"))
    return out.withColumn("score", score)


def issues(profile: DataFrame, by: str = KEY) -> DataFrame:
    """One row for every fault of a profile: its code and severity."""
    faults = {
        ("MISSING_VALUES", "warning"): F.col("n_missing") > 0,
        ("DUPLICATE_TIMESTAMPS", "warning"): F.col("n_duplicates") > 0,
        ("IRREGULAR_SAMPLING", "warning"): F.col("irregular_rate") > 0.01,
        ("FROZEN_SEGMENTS", "warning"): F.col("n_frozen") > 0,
        ("IQR_ANOMALIES", "info"): F.col("n_anomalies") > 0,
    }
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("issue"), F.lit(level).alias("severity"))) for (k, level), c in faults.items()]))
    return profile.select(by, F.explode(found).alias("f")).select(by, "f.issue", "f.severity")


def recommendations(profile: DataFrame, by: str = KEY) -> DataFrame:
    """What to do about a profile's faults, in order: one row a step, ``proceed`` where nothing is to be done."""
    steps = {
        "interpolate": F.col("n_missing") > 0,
        "resample": F.col("sample_period_seconds").isNotNull() & (F.col("irregular_rate") > 0.01),
        "settle_duplicates": F.col("n_duplicates") > 0,
        "mark_frozen": F.col("n_frozen") > 0,
        "review_anomalies": F.col("n_anomalies") > 0,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in steps.items()]))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("proceed")))
    return profile.select(by, F.posexplode(found).alias("place", "step"))


def downsampled(df: DataFrame, most: int, last: bool = True, by: str = KEY, row: str = "row", n: str = "n") -> DataFrame:
    """Every k-th row of a series of ``n`` rows numbered from 0: with ``last`` the final row too and k = ceil(n / most), else k = max(1, n // most)."""
    k = F.ceil(F.col(n) / most) if last else F.greatest(F.lit(1), F.floor(F.col(n) / most))
    keep = F.col(row) % F.greatest(F.lit(1), k) == 0
    return df.filter(keep | (F.col(row) == F.col(n) - 1) if last else keep)


def collapse_duplicates(df: DataFrame, value: str = "v", ts: str = "ts", by: str = KEY, order: str = "ord") -> DataFrame:
    """One row a time: the mean of the values present, and the first value in file order even if missing."""
    first = F.min_by(F.struct(F.col(value).alias("x")), F.col(order))["x"]
    return df.groupBy(by, ts).agg(F.avg(value).alias("mean"), first.alias("first"), F.count("*").alias("n_rows"))


def resample(df: DataFrame, period: int, value: str = "v", ts: str = "ts", by: str = KEY) -> DataFrame:
    """Means on a regular grid that starts at a series' first time; a row goes to the nearest step, empty steps are null."""
    span = df.groupBy(by).agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"))
    binned = df.join(span, by).withColumn("step", F.floor((F.col(ts) - F.col("t0")) / period + 0.5))
    means = binned.groupBy(by, "step").agg(F.avg(value).alias("mean"))
    steps = span.select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / period + 1e-9))).alias("step"))
    return steps.join(means, [by, "step"], "left")


def noise_sigma(df: DataFrame, value: str = "v", by: str = KEY, at: str = AT) -> DataFrame:
    """Robust noise level from second differences of the values present; 0 under four values."""
    present = df.filter(F.col(value).isNotNull())
    w = Window.partitionBy(by).orderBy(at)
    second = present.withColumn("d", F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w))
    centre = second.groupBy(by).agg(F.percentile("d", F.lit(0.5)).alias("c"), F.count(value).alias("m"))
    mad = second.join(centre, by).groupBy(by).agg(F.percentile(F.abs(F.col("d") - F.col("c")), F.lit(0.5)).alias("mad"), F.max("m").alias("m"))
    return mad.select(by, F.when(F.col("m") < 4, 0.0).otherwise(1.4826 * F.col("mad") / 6**0.5).alias("noise_sigma"))


#: Features of a fingerprint, in the order of its vector; each lies between -1 and about 1.
FEATURES = ("log_sample_count", "input_count", "missing_ratio", "anomaly_ratio", "snr_db_scaled", "dynamic_ratio", "output_autocorrelation", "input_autocorrelation", "collinearity_scaled")


def fingerprint(df: DataFrame, inputs: list[str], output: str, by: str = KEY, at: str = AT) -> DataFrame:
    """``features`` by which series are compared: length, inputs, missing and anomalous shares, signal to noise, share of moving
    steps, lag-one correlations and the strongest correlation between inputs.

    Lags skip missing values. Medians and means, then deviations from the medians, are windows over the whole series in the order that
    the lags need, so rows are dealt and sorted once, joined to nothing, and summed in order of time.
    """
    signals = [*inputs, output]
    i = len(inputs)
    present = df.filter(F.col(by).isNotNull())
    w = Window.partitionBy(by).orderBy(at)
    for k, c in enumerate(signals):  # the value present before this one, and the one before that
        before = F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        present = present.withColumn(f"__p{k}", F.when(F.col(c).isNotNull(), before))
    y = F.col(output)
    earlier = F.last(F.when(y.isNotNull(), F.col(f"__p{i}")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    present = present.withColumn("__second", F.when(y.isNotNull(), y - 2 * F.col(f"__p{i}") + earlier))
    all_ = Window.partitionBy(by)
    first = {"__median": F.percentile(output, F.lit(0.5)), "__centre": F.percentile("__second", F.lit(0.5)), "__m": F.count(output), "__power": F.var_pop(output)}
    first |= {f"__mean{k}": F.avg(c) for k, c in enumerate(signals)}
    first |= {f"__step{k}": F.percentile(F.abs(F.col(c) - F.col(f"__p{k}")), F.lit(0.95)) for k, c in enumerate(inputs)}
    rows = present.withColumns({k: e.over(all_) for k, e in first.items()}).withColumns({f"__still{k}": F.col(f"__step{k}") * 0.05 for k in range(i)})
    rows = rows.withColumns({"__off": F.abs(y - F.col("__median")), "__noise": F.abs(F.col("__second") - F.col("__centre"))})
    rows = rows.withColumns({"__mad": F.percentile("__off", F.lit(0.5)).over(all_), "__nad": F.percentile("__noise", F.lit(0.5)).over(all_)})
    centred = lambda k, c: F.col(c) - F.col(f"__mean{k}")
    sums = {"n": F.count("*"), "gone": sum((F.count_if(F.col(c).isNull()) for c in signals[1:]), F.count_if(F.col(signals[0]).isNull())), "odd": F.count_if((F.col("__mad") > 0) & (F.col("__off") > 3 * 1.4826 * F.col("__mad")))}
    for k, c in enumerate(signals):
        x = centred(k, c)
        r = F.sum(x * (F.col(f"__p{k}") - F.col(f"__mean{k}"))) / F.sum(x * x)
        sums[f"r{k}"] = F.when((F.count(c) >= 3) & (F.sum(x * x) > 0), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))).otherwise(0.0)
    for k, c in enumerate(inputs):
        step = F.abs(F.col(c) - F.col(f"__p{k}"))
        sums[f"d{k}"] = F.when(F.count(step) > 0, F.when(F.max(f"__still{k}") > 0, F.count_if(step > F.col(f"__still{k}")) / F.count(step)).otherwise(0.0))
    pairs = []
    for a in range(i):
        for b in range(a + 1, i):
            both = F.col(inputs[a]).isNotNull() & F.col(inputs[b]).isNotNull()
            r = F.corr(F.when(both, F.col(inputs[a])), F.when(both, F.col(inputs[b])))
            pairs.append(F.when(F.count_if(both) >= 3, F.coalesce(F.abs(F.when(~F.isnan(r), r)), F.lit(0.0))).otherwise(0.0))
    sums["pair"] = F.greatest(*pairs, F.lit(0.0)) if pairs else F.lit(0.0)
    out = rows.groupBy(by).agg(*[F.first(k).alias(k) for k in ("__m", "__power", "__mad", "__nad")], *[e.alias(f"__{k}") for k, e in sums.items()])
    moving = F.array_compact(F.array(*[F.col(f"__d{k}") for k in range(i)])) if inputs else F.array().cast("array<double>")
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)
    sigma = F.when(F.col("__m") < 4, 0.0).otherwise(1.4826 * F.col("__nad") / 6**0.5)
    snr = F.when((sigma > 0) & (F.col("__power") > 0), 10 * F.log10(F.col("__power") / (sigma * sigma))).otherwise(60.0)
    n = F.greatest("__n", F.lit(1))
    vector = [
        F.log10(n) / 6.0, F.lit(min(i, 8) / 8.0), F.col("__gone") / (n * len(signals)), F.when(F.col("__m") >= 8, F.col("__odd") / F.col("__m")).otherwise(0.0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), snr / 60.0)),
        mean(moving), F.col(f"__r{i}"), mean(F.array(*[F.col(f"__r{k}") for k in range(i)])) if inputs else F.lit(0.0), F.least(F.lit(1.0), F.col("__pair")),
    ]
    return out.select(by, F.array(*vector).alias("features"))


def nearest(prints: DataFrame, most: float = 0.35, top: int = 3, by: str = KEY, cells: int = 3, compared: list[int] | None = None) -> DataFrame:
    """``other, distance, rank``: the series most like each one, by distance of ``features``, ties by name.

    As ``pivots.nearest``, but series meet in cells over the ``cells`` last features instead of rings about pivots: equal fingerprints are
    one point, and cells are as wide as the radius, which grows up to ``most`` only for series that have too few others nearby.
    """
    from . import pivots

    n = len(FEATURES)
    return pivots.nearest(prints, most, top, by, compared=compared, features=[n - 1 - k for k in range(cells)])
