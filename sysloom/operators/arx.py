"""ARX models: fit by chronological parts, judge one step ahead and in free run."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sysloom.functions.scalars import fit_percent, scores

from .keep import kept
from .linear import least_squares, triangles
from .profile import AT, KEY
from .regressor import Structure, regressor


@dataclass(frozen=True)
class Split:
    train: float = 0.6
    validation: float = 0.2


def parts(rows: DataFrame, history: int, n: DataFrame, split: Split = Split(), by: str = KEY, at: str = AT) -> DataFrame:
    """``rows`` with ``part``: train, validation or test by time, the steps within ``history`` of a boundary in none."""
    a, b = F.floor(F.col("__n") * split.train), F.floor(F.col("__n") * (split.train + split.validation))
    t = F.col(at)
    part = F.when(t < a - history, "train").when((t >= a + history) & (t < b - history), "validation").when(t >= b + history, "test")
    return rows.join(n, by).withColumn("part", part).drop("__n")


def predicted(rows: DataFrame, models: DataFrame, features: list[str], by: str = KEY) -> DataFrame:
    """``rows`` with the one-step prediction ``predicted`` of each series' ``theta``."""
    out = F.lit(0.0)
    for i, c in enumerate(features):
        out = out + F.col(c) * F.get("theta", i)
    return rows.withColumn(by, F.col(by).cast("string")).join(models.select(by, "theta"), by).withColumn("predicted", out).drop("theta")


def stable(theta: list[float], na: int) -> tuple[bool, float]:
    """Whether all poles lie inside the unit circle, and the largest modulus."""
    top = max(np.abs(np.roots([1.0, *theta[:na]])), default=0.0)
    return bool(top < 1), float(top)


def gains(models: DataFrame, s: Structure, by: str = KEY) -> DataFrame:
    """``input, gain``: steady-state gain of every input; null where the denominator vanishes."""
    denominator = 1.0 + F.aggregate(F.slice("theta", 1, s.na), F.lit(0.0), lambda a, x: a + x)
    at, cells = s.na, []
    for u in s.inputs:
        top = F.aggregate(F.slice("theta", at + 1, s.nb[u]), F.lit(0.0), lambda a, x: a + x)
        cells.append(F.struct(F.lit(u).alias("input"), F.when(F.abs(denominator) >= 1e-12, top / denominator).alias("gain")))
        at += s.nb[u]
    return models.select(by, F.explode(F.array(*cells)).alias("g")).select(by, "g.input", "g.gain")


def free_run(df: DataFrame, models: DataFrame, s: Structure, output: str = "y", by: str = KEY, at: str = AT, restart: int | None = None, within: str | None = None) -> DataFrame:
    """``t, y, simulated``: the output simulated from measured inputs and its own past, started on measured values.

    What the inputs add comes from windows in Spark; only the recursion itself steps through a series, all of it unless
    ``restart`` starts it anew every so many steps (another question, but one that several tasks can share) or ``within``, a
    column, wherever that changes; steps where it is null are left out. Values are held to a thousand times the largest measured one.
    """
    w = Window.partitionBy(by).orderBy(at)
    drive, i = F.lit(0.0), s.na
    for u in s.inputs:
        for k in range(s.nb[u]):
            drive = drive + F.get("theta", i) * F.lag(u, s.nk[u] + k).over(w)
            i += 1
    rows = df.withColumn(by, F.col(by).cast("string")).join(models.select(by, "theta"), by)
    rows = rows.select(by, at, F.col(output).alias("y"), F.slice("theta", 1, s.na).alias("a"), drive.alias("drive"), F.row_number().over(w).alias("i"), F.max(F.abs(output)).over(Window.partitionBy(by)).alias("top"), *([within] if within else []))
    rows = rows.withColumn("stretch", F.col(within) if within else F.floor(F.col(at) / restart) if restart else F.lit(0).cast("long")).filter("stretch is not null")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(at)
        y, drive = table["y"].to_numpy(), table["drive"].to_numpy().astype(float)
        a, start = np.array(table["a"][0].as_py()), table["i"].to_numpy()
        limit = 1e3 * max(table["top"][0].as_py() or 1.0, 1.0)
        out = np.array(y, float)
        for k in range(len(out)):
            if start[k] > s.history and k >= s.na:
                out[k] = np.clip(drive[k] - a @ out[k - s.na : k][::-1], -limit, limit)
        return pa.table({by: table[by], at: table[at], "y": table["y"], "simulated": pa.array(out)})

    return rows.groupBy(by, "stretch").applyInArrow(run, f"{by} string, {at} long, y double, simulated double")


def autocorrelation(rows: DataFrame, value: str, max_lag: int = 20, by: str = KEY, at: str = AT) -> DataFrame:
    """``lag, acf, n``: biased autocorrelation of ``value`` about its mean."""
    w = Window.partitionBy(by).orderBy(at)
    c = rows.withColumn("c", F.col(value) - F.avg(value).over(Window.partitionBy(by)))
    lagged = c.select(by, "c", *[F.lag("c", k).over(w).alias(f"c{k}") for k in range(max_lag + 1)])
    wide = lagged.groupBy(by).agg(F.count("*").alias("n"), *[(F.coalesce(F.sum(F.col("c") * F.col(f"c{k}")), F.lit(0.0)) / F.sum(F.col("c") * F.col("c"))).alias(f"r{k}") for k in range(max_lag + 1)])
    return wide.select(by, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("acf")) for k in range(max_lag + 1)])).alias("x")).select(by, "x.lag", "x.acf", "n")


def whiteness(acf: DataFrame, by: str = KEY) -> DataFrame:
    """Share of the lags from 1 on within 1.96 deviations of zero."""
    return acf.filter("lag >= 1").groupBy(by).agg(F.avg(F.when(F.abs("acf") <= 1.96 / F.sqrt("n"), 1.0).otherwise(0.0)).alias("whiteness"))


def information_criteria(rss: Column, n: Column, p: int) -> dict[str, Column]:
    return {"aic": n * F.log(rss / n) + 2 * p, "bic": n * F.log(rss / n) + p * F.log(n)}


def fit(df: DataFrame, s: Structure, ridge: float = 0.0, split: Split = Split(), output: str = "y", by: str = KEY, at: str = AT, keep: DataFrame | None = None) -> dict[str, DataFrame]:
    """Models fitted on the training part (rows that ``keep`` lists, if given) and judged on every part.

    Returns ``models`` (theta, n, rank, condition, rss), ``refused`` (series without a model and why), ``one_step`` (scores of each
    part), ``simulation`` (free-run fit of each part), ``gains``, ``residuals`` and ``summary``: AIC and BIC of the training rows,
    whether the model is stable and its largest pole, and on the validation part both fits, their gap and the share of
    white residuals. A series with no more training rows than twice its parameters has no model, nor without ``ridge`` one
    whose regressor lacks full rank.
    """
    n = df.groupBy(by).agg((F.max(at) + 1).alias("__n"))
    rows = parts(regressor(df, s, output, by, at), s.history, n, split, by, at).withColumn(by, F.col(by).cast("string"))
    train = rows.filter("part = 'train'")
    if keep is not None:
        train = train.join(keep.select(F.col(by).cast("string").alias(by), at).distinct(), [by, at], "left_semi")
    p = len(s.features)
    every = kept(least_squares(train, s.features, "target", by, ridge))  # one row a series, read by all that follows
    why = F.when(F.col("n") <= 2 * p, "INSUFFICIENT_ROWS").when(F.lit(not ridge) & (F.col("rank") < p), "DESIGN_MATRIX_RANK_DEFICIENT")
    models, refused = every.filter(why.isNull()), every.select(by, "n", "rank", why.alias("reason")).filter("reason is not null")
    ahead = predicted(rows, models, s.features, by)
    one_step = ahead.filter("part is not null").groupBy(by, "part").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in scores(F.col("target"), F.col("predicted")).items()])
    ran = free_run(parts(df, s.history, n, split, by, at), models, s, output, by, at, within="part")  # starts on measured values in each part
    ran = parts(ran, s.history, n.withColumn(by, F.col(by).cast("string")), split, by, at)
    simulation = ran.filter("part is not null and y is not null").groupBy(by, "part").agg(fit_percent(F.col("y"), F.col("simulated")).alias("free_run_fit"))
    residuals = ahead.withColumn("residual", F.col("target") - F.col("predicted"))
    held = residuals.filter("part = 'validation'")
    white = whiteness(autocorrelation(held, "residual", 20, by, at), by)
    found = one_step.filter("part = 'validation'").select(by, F.col("fit").alias("one_step_fit"), F.col("rmse").alias("validation_rmse"))
    free = simulation.filter("part = 'validation'").select(by, "free_run_fit")
    criteria = information_criteria(F.col("rss"), F.col("n"), p)
    summary = stability(models, s.na, by).join(models.select(by, *[F.when(F.col("rss") > 0, c).alias(k) for k, c in criteria.items()]), by)
    summary = summary.join(found, by, "left").join(free, by, "left").join(white, by, "left").withColumn("fit_gap", F.col("one_step_fit") - F.col("free_run_fit"))
    return {"models": models, "refused": refused, "one_step": one_step, "simulation": simulation, "gains": gains(models, s, by), "residuals": residuals, "summary": summary}


def stability(models: DataFrame, na: int, by: str = KEY) -> DataFrame:
    """``stable, max_pole`` of every model: whether all poles lie inside the unit circle."""

    def look(batches):
        for batch in batches:
            got = [stable(theta, na) for theta in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.float64())], [by, "stable", "max_pole"])

    return models.select(F.col(by).cast("string").alias(by), "theta").mapInArrow(look, f"{by} string, stable boolean, max_pole double")


@dataclass(frozen=True)
class Priors:
    """What is known of a process beforehand: signs and bounds of gains, and whether it is stable."""

    signs: dict[str, str]
    bounds: dict[str, tuple[float, float]]
    require_stable: bool = False


def violations(fitted: dict[str, DataFrame], priors: Priors, by: str = KEY) -> DataFrame:
    """``variable, kind, expected, actual``: every prior that a series' model breaks; gains that don't exist break none."""
    rules = [(u, "gain_sign", sign, 0.0, 0.0) for u, sign in priors.signs.items()] + [(u, "gain_bounds", f"[{lo}, {hi}]", float(lo), float(hi)) for u, (lo, hi) in priors.bounds.items()]
    gains_ = fitted["gains"].filter(F.col("gain").isNotNull() & ~F.isnan("gain") & (F.abs("gain") < float("inf")))
    out = None
    for u, kind, expected, lo, hi in rules:
        g = F.col("gain")
        broken = (g <= 0 if expected == "positive" else g >= 0) if kind == "gain_sign" else (g < lo) | (g > hi)
        row = gains_.filter((F.col("input") == u) & broken).select(F.col(by).cast("string").alias(by), F.col("input").alias("variable"), F.lit(kind).alias("kind"), F.lit(expected).alias("expected"), g.alias("actual"))
        out = row if out is None else out.unionByName(row)
    if priors.require_stable:
        row = fitted["summary"].filter(~F.col("stable")).select(by, F.lit("__model__").alias("variable"), F.lit("stability").alias("kind"), F.lit("all poles inside the unit circle").alias("expected"), F.col("max_pole").alias("actual"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else gains_.select(F.col(by).cast("string").alias(by), F.col("input").alias("variable"), F.lit("").alias("kind"), F.lit("").alias("expected"), F.col("gain").alias("actual")).limit(0)


def structures(inputs: list[str], nas: tuple[int, ...] = (1, 2, 3, 4), nbs: tuple[int, ...] = (1, 2, 3), nk: int = 0) -> Iterator[Structure]:
    for na in nas:
        for nb in nbs:
            yield Structure.of(inputs, na, nb, nk)


def objective(free_run_fit: Column, rmse: Column, one_step_fit: Column, white: Column, parameters: Column, stable_: Column) -> Column:
    """Worth of a trial: free-run fit less relative error, coloured residuals and size; minus infinity for an unstable model or one without a free run.

    The error is the rmse over the size of the one-step fit, as it stands where that fit is 0; unknown whiteness counts as white.
    """
    clip = lambda c, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), c))
    size = F.abs(F.coalesce(one_step_fit, F.lit(0.0)))
    error = F.coalesce(rmse, F.lit(0.0)) / F.when(size > 0, size).otherwise(1.0)
    value = 0.45 * clip(free_run_fit / 100, -1.0, 1.0) - 0.20 * clip(error, 0.0, 3.0) - 0.10 * (1 - clip(F.coalesce(F.when(~F.isnan(white), white), F.lit(1.0)), 0.0, 1.0)) - 0.10 * clip(parameters / 40.0, 0.0, 1.0)
    return F.when(stable_ & free_run_fit.isNotNull() & ~F.isnan(free_run_fit), value).otherwise(float("-inf"))


def simulated_fit(y: np.ndarray, drive: np.ndarray, a: np.ndarray, first: int, top: float) -> float | None:
    """Free-run fit in percent over a stretch whose first ``first`` values are measured; null for a constant one. Values are held to 1000 ``top``."""
    out, na, limit = y.astype(float).copy(), len(a), 1e3 * max(top, 1.0)
    for k in range(first, len(y)):
        out[k] = min(limit, max(-limit, drive[k] - float(a @ out[k - na : k][::-1])))
    seen, got = y[first:], out[first:]
    spread = float(((seen - seen.mean()) ** 2).sum()) if len(seen) else 0.0
    return max(-100.0, 100 * (1 - (float(((seen - got) ** 2).sum()) / spread) ** 0.5)) if spread > 0 else None


def search(df: DataFrame, inputs: list[str], output: str = "y", ridges: tuple[float, ...] = (0.0, 0.1), split: Split = Split(), by: str = KEY, at: str = AT, nk: int = 0, keep: DataFrame | None = None) -> DataFrame:
    """One row a series and trial of the structure grid (by na, nb and ridge): fits on the validation part, error, white share, poles and ``value``.

    The widest regressor is built once, and its training rows (those of ``keep``, if given) are reduced to a triangle; every model
    of fewer lags is solved on columns of it, so trials cost no further pass over the training rows. The validation rows of a
    series and the models of one ``na`` then meet in a task, as a free run has to step through them.
    """
    wide = Structure.of(inputs, 4, 3, nk)
    n = df.groupBy(by).agg((F.max(at) + 1).alias("__n"))
    rows = parts(regressor(df, wide, output, by, at), wide.history, n, split, by, at).withColumn(by, F.col(by).cast("string"))
    train = rows.filter("part = 'train'")
    if keep is not None:
        train = train.join(keep.select(F.col(by).cast("string").alias(by), at).distinct(), [by, at], "left_semi")
    columns = [*wide.features, "target"]
    factors = triangles(train, columns, by)
    trials = [(number, s, r) for number, (s, r) in enumerate((s, r) for s in structures(inputs, nk=nk) for r in ridges)]
    held = rows.filter("part = 'validation'").select(by, at, *columns)
    top = df.groupBy(F.col(by).cast("string").alias(by)).agg(F.max(F.abs(F.col(output))).alias("__top"))
    held = held.join(top, by).withColumn("na", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])))
    models = factors.withColumn("na", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows > 21:
            key, na, n_train = left[by][0].as_py(), left["na"][0].as_py(), left["n"][0].as_py()
            train_ = np.array(left["r"][0].as_py()).reshape(-1, len(columns))
            right = right.sort_by(at)
            x, t = np.column_stack([right[c].to_numpy() for c in columns]), right[at].to_numpy()
            y, whole = x[:, -1], bool((np.diff(t) == 1).all())
            for number, s, ridge in trials:
                if s.na != na:
                    continue
                use = [wide.features.index(c) for c in s.features]
                a, b = train_[:, use], train_[:, -1]
                if n_train <= 2 * len(use) or not ridge and np.linalg.matrix_rank(a, tol=np.linalg.norm(a, 2) * max(n_train, len(use)) * np.finfo(float).eps) < len(use):
                    continue
                theta = np.linalg.solve(a.T @ a + ridge * np.eye(len(use)), a.T @ b) if ridge else np.linalg.lstsq(a, b, rcond=None)[0]
                error = y - x[:, use] @ theta
                spread = float(((y - y.mean()) ** 2).sum())
                ahead = 100 * (1 - (float(error @ error) / spread) ** 0.5) if spread > 0 else None
                good, modulus = stable(theta.tolist(), na)
                drive = x[:, use[na:]] @ theta[na:]
                free = simulated_fit(y, drive, theta[:na], na, right["__top"][0].as_py() or 0.0) if whole else None
                centred = error - error.mean()
                bound, power = 1.96 / len(error) ** 0.5, float(centred @ centred)
                white = float(np.mean([abs(float(centred[:-k] @ centred[k:]) / power) <= bound for k in range(1, 21)])) if power > 0 else None
                out.append((key, number, s.na, s.nb[inputs[0]], ridge, len(use), free, ahead, (float(error @ error) / len(y)) ** 0.5, white, good, modulus))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), *[pa.float64()] * 4, pa.bool_(), pa.float64()]
        names = [by, "trial", "na", "nb", "ridge", "parameters", "free_run_fit", "one_step_fit", "rmse", "whiteness", "stable", "max_pole"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 12, kinds, strict=True)], names=names)

    schema = f"{by} string, trial int, na int, nb int, ridge double, parameters int, free_run_fit double, one_step_fit double, rmse double, whiteness double, stable boolean, max_pole double"
    got = models.groupBy(by, "na").cogroup(held.groupBy(by, "na")).applyInArrow(judge, schema)
    return got.withColumn("value", objective(F.col("free_run_fit"), F.col("rmse"), F.col("one_step_fit"), F.col("whiteness"), F.col("parameters"), F.col("stable")))


def best_trials(trials: DataFrame, by: str = KEY) -> DataFrame:
    """The trial of highest value of each series; the first on ties."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("value"), "trial"))
    return trials.withColumn("__r", rank).filter("__r = 1").drop("__r")
