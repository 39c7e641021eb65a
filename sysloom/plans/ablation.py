"""Experiments over series: which choice of windows, which measure and which delay estimate holds up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sysloom.functions.scalars import fit_percent
from sysloom.operators import arx, delay, linear, regressor, selection
from sysloom.operators.keep import kept
from sysloom.operators.profile import AT, KEY, noise_sigma
from sysloom.operators.regressor import Structure


def ranked_windows(df: DataFrame, s: Structure, sizes: list[int], most: int, output: str = "y", train: float = 0.6, by: str = KEY, at: str = AT) -> tuple[DataFrame, DataFrame]:
    """The regressor of the training part, and ``size, strategy, window, rank, lo, hi``: the ``most`` best windows of each size by input energy,
    weighted score and information.

    The regressor is derived once. Energies and information come from one pass of running sums whatever the sizes; a smaller budget's
    windows are the first of a larger one's, so all budgets share these ranks.
    """
    part = kept(regressor.chronological(df, 0.0, train, by, at).withColumn(by, F.col(by).cast("string")))
    rows = kept(regressor.regressor(part, s, output, by, at))
    grams = kept(selection.window_grams(rows, s.features, [(size, size // 2) for size in sizes], by))
    diagonal = [i for i, (a, b) in enumerate(selection.products(s.features)) if a == b and s.features[a] in {f"b_{u}_0" for u in s.inputs}]
    energy = grams.select(by, "size", "window", sum((F.get("products", i) for i in diagonal), F.lit(0.0)).alias("score"), F.lit("energy").alias("strategy"))
    marked, sigma = kept(rows.select(by, at, "row").join(regressor.with_anomalies(part, [*s.inputs, output], by=by, at=at), [by, at])), noise_sigma(part, output, by, at)
    scores = energy
    for size in sizes:
        signals = regressor.window_rows(marked, size, size // 2, by)
        quality = regressor.window_quality(signals, s.inputs, output, sigma, by, at)
        weighted = regressor.weighted_scores(signals, quality, s.inputs, output, by, at)
        scores = scores.unionByName(weighted.select(by, F.lit(size).cast("long").alias("size"), "window", "score", F.lit("weighted").alias("strategy")))
    place = F.row_number().over(Window.partitionBy(by, "size", "strategy").orderBy(F.desc("score"), "window"))
    best = scores.withColumn("rank", place).filter(F.col("rank") <= most).select(by, "size", "strategy", "window", "rank")
    told = selection.informative_of(grams, len(s.features), most, by=by).select(by, "size", F.lit("information").alias("strategy"), "window", "rank")
    lo = F.col("window") * F.floor(F.col("size") / 2)
    return rows, best.unionByName(told).withColumns({"lo": lo, "hi": lo + F.col("size") - 1})


def chosen_steps(rows: DataFrame, best: DataFrame, budgets: list[int], by: str = KEY, at: str = AT) -> DataFrame:
    """``size, budget, strategy`` and step of every training row in the windows that each budget admits."""
    each = best.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).filter("rank <= budget")
    taken = each.withColumn("row", F.explode(F.sequence("lo", "hi"))).select(by, "size", "budget", "strategy", "row").distinct()
    return taken.join(rows.select(by, "row", at), [by, "row"]).select(by, at, "size", "budget", "strategy")


def fits(df: DataFrame, s: Structure, keep: DataFrame, output: str = "y", by: str = KEY, at: str = AT, split: arx.Split = arx.Split()) -> DataFrame:
    """``choice, n_rows, rank, condition, one_step_fit, free_run_fit, fit_gap`` of the model of every choice of training steps.

    ``keep``: ``choice`` and step. The regressor is derived once; of a choice only its own rows are fitted, and only the validation part is
    run again for each. Without full rank, or with too few rows, there is no model, hence no scores.
    """
    n = df.groupBy(by).agg((F.max(at) + 1).alias("__n"))
    rows = kept(arx.parts(regressor.regressor(df, s, output, by, at), s.history, n, split, by, at).withColumn(by, F.col(by).cast("string")))
    key = F.concat_ws("\u0001", F.col(by), F.col("choice")).alias("key")
    train = rows.filter("part = 'train'").join(keep.select(F.col(by).cast("string").alias(by), at, "choice").distinct(), [by, at]).select(key, "target", *s.features)
    p = len(s.features)
    models = kept(linear.least_squares(train, s.features, "target", "key"))
    sound = models.filter((F.col("n") > 2 * p) & (F.col("rank") >= p)).select("key", F.get(F.split("key", "\u0001"), 0).alias(by), "theta")
    n = n.withColumn(by, F.col(by).cast("string"))
    own = (F.col(at) >= F.floor(F.col("__n") * split.train)) & (F.col(at) < F.floor(F.col("__n") * (split.train + split.validation)))  # lags of the part reach no further back
    seen = df.withColumn(by, F.col(by).cast("string")).join(n, by).filter(own).select(by, at, output, *s.inputs)
    ahead = rows.filter("part = 'validation'").join(sound, by).withColumn("predicted", sum((F.col(c) * F.get("theta", i) for i, c in enumerate(s.features)), F.lit(0.0)))
    one_step = ahead.groupBy("key").agg(fit_percent(F.col("target"), F.col("predicted")).alias("one_step_fit"))
    copies = arx.parts(seen.join(sound.select(by, "key"), by), s.history, n, split, by, at)
    ran = arx.free_run(copies, sound, s, output, "key", at, within="part")
    free = ran.filter("y is not null").groupBy("key").agg(fit_percent(F.col("y"), F.col("simulated")).alias("free_run_fit"))
    out = models.select("key", F.col("n").alias("n_rows"), "rank", F.when((F.col("n") > 2 * p) & (F.col("rank") >= p), F.col("condition")).otherwise(1e12).alias("condition"))
    out = out.join(one_step.join(free, "key", "full"), "key", "left").withColumn("fit_gap", F.col("one_step_fit") - F.col("free_run_fit")).withColumn("key", F.split("key", "\u0001"))
    return out.select(F.get("key", 0).alias(by), F.get("key", 1).alias("choice"), *out.columns[1:])


def selection_ablation(df: DataFrame, s: Structure, size: int = 60, budget: int = 12, output: str = "y", by: str = KEY, at: str = AT) -> DataFrame:
    """Rows used, rank, condition and validation scores of the model that each strategy's steps give; ``full``: all training steps."""
    rows, best = ranked_windows(df, s, [size], budget, output, by=by, at=at)
    steps = chosen_steps(rows, best, [budget], by, at).select(by, at, F.col("strategy").alias("choice"))
    return fits(df, s, steps.unionByName(rows.select(by, at, F.lit("full").alias("choice"))), output, by, at).drop("fit_gap").withColumnRenamed("choice", "strategy")


def metric_ablation(df: DataFrame, s: Structure, output: str = "y", train: float = 0.6, starved: tuple[int, int] = (20, 240), by: str = KEY, at: str = AT) -> DataFrame:
    """How far one-step and free-run fits tell a model of all training steps from one of a few, on the validation part."""
    steps = regressor.chronological(df, 0.0, train, by, at).select(by, at)
    few = steps.filter((F.col(at) >= starved[0]) & (F.col(at) < starved[1]))
    keep = steps.select(by, at, F.lit("well_fitted").alias("choice")).unionByName(few.select(by, at, F.lit("starved").alias("choice")))
    return fits(df, s, keep, output, by, at).select(by, F.col("choice").alias("strategy"), "one_step_fit", "free_run_fit", "fit_gap")


def discrimination(rows: DataFrame, by: str = KEY) -> DataFrame:
    """``one_step, free_run, ratio``: spread of either fit over a series' models, and theirs to one another (null where the first is nil)."""
    spread = rows.groupBy(by).agg((F.max("one_step_fit") - F.min("one_step_fit")).alias("one_step"), (F.max("free_run_fit") - F.min("free_run_fit")).alias("free_run"), F.count("*").alias("n"))
    return spread.filter("n >= 2").select(by, "one_step", "free_run", F.when(F.col("one_step") > 1e-9, F.col("free_run") / F.col("one_step")).alias("ratio"))


def sensitivity(df: DataFrame, s: Structure, sizes: tuple[int, ...] = (30, 40, 60, 80, 120), budgets: tuple[int, ...] = (4, 8, 12, 20), output: str = "y", by: str = KEY, at: str = AT) -> DataFrame:
    """Rows, free-run fit, rank and condition under every strategy, over a grid of window sizes and budgets, in one job over all of it."""
    rows, best = ranked_windows(df, s, list(sizes), max(budgets), output, by=by, at=at)
    choice = F.concat_ws("\u0002", "size", "budget", "strategy")
    steps = chosen_steps(rows, best, list(budgets), by, at).select(by, at, choice.alias("choice"))
    full = rows.select(by, at, F.lit("0\u00020\u0002full").alias("choice"))  # the same whatever the window, so fitted once
    part = lambda i: F.get(F.split("choice", "\u0002"), i)
    return fits(df, s, steps.unionByName(full), output, by, at).select(by, part(0).cast("int").alias("size"), part(1).cast("int").alias("budget"), part(2).alias("strategy"), "n_rows", "rank", "condition", "free_run_fit")


def wins(rows: DataFrame, by: str = KEY, score: str = "free_run_fit", choice: str = "strategy", cell: tuple[str, ...] = ("size", "budget")) -> DataFrame:
    """``n_best`` of every choice: the cells in which it has the largest score, ties to the first by name; cells without a score count for none."""
    scored = rows.filter(F.col(score).isNotNull())
    best = scored.groupBy(by, *cell).agg(F.min(F.struct((-F.col(score)).alias("least"), F.col(choice).alias("choice")))["choice"].alias(choice))
    names = rows.select(by, choice).distinct()
    return names.join(best.groupBy(by, choice).agg(F.count("*").alias("n_best")), [by, choice], "left").select(by, choice, F.coalesce("n_best", F.lit(0)).alias("n_best"))


def self_benchmark(df: DataFrame, s: Structure, output: str = "y", by: str = KEY) -> DataFrame:
    """One row a series: what the choice of windows, the measure and the delay estimate make of it."""
    chosen = selection_ablation(df, s, output=output, by=by).groupBy(by).agg(*[F.max(F.when(F.col("strategy") == k, F.col("free_run_fit"))).alias(f"{k}_fit") for k in ("full", "energy", "weighted", "information")])
    told = discrimination(metric_ablation(df, s, output, by=by), by).select(by, F.col("ratio").alias("discrimination"))
    lags = delay_ablation(df, s.inputs, output, by=by).groupBy(by).agg(F.count_if(~F.col("raw_lag").eqNullSafe(F.col("prewhitened_lag"))).alias("moved_peaks"))
    return chosen.join(told, by, "left").join(lags, by, "left")


def delay_ablation(df: DataFrame, inputs: list[str], output: str = "y", max_lag: int = 10, by: str = KEY) -> DataFrame:
    """Lag of the strongest correlation of each input, raw and prewhitened."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    top = lambda curve, name: delay.peaks(curve.withColumn(by, F.col(by).cast("string")), n.withColumn(by, F.col(by).cast("string")), 1, by).select(by, F.col("lag").alias(name))
    out = None
    for u in inputs:
        raw = top(delay.cross_correlation(df, u, output, max_lag, by), "raw_lag")
        white = top(delay.prewhitened(df, u, output, max_lag, 6, by), "prewhitened_lag")
        row = raw.join(white, by, "full").withColumn("input", F.lit(u))
        out = row if out is None else out.unionByName(row)
    return out
