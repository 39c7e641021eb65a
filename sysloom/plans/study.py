"""A study: selection parameters and delays asked for in batches, a choice of windows for each, all model structures on it, the best kept;
and the memory by which a study starts from what others have found."""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sysloom.functions.scalars import distance
from sysloom.operators import arx, profile, regressor, selection
from sysloom.operators.keep import kept
from sysloom.operators.profile import AT, KEY, noise_sigma

#: Lower end, upper end and step of every parameter.
SPACE = {"window": (30, 200, 10), "segments": (3, 20, 1), "anomalies": (0.02, 0.30, 0.02), "missing": (0.02, 0.40, 0.02), "activity": (0.02, 0.30, 0.02), "nk": (0, 20, 1)}


def grid(space: Mapping[str, tuple] = SPACE) -> dict[str, list[float]]:
    """All values of every parameter."""
    return {k: [round(lo + i * step, 10) for i in range(int((hi - lo) / step + 1e-9) + 1)] for k, (lo, hi, step) in space.items()}


def parzen(points: list[int], size: int) -> np.ndarray:
    """Density over a parameter's ``size`` values: a bell about each of ``points``, the wider the fewer they are, and an even share."""
    at, width = np.arange(size), max(1.0, size / (2 * (1 + len(points)) ** 0.5))
    out = np.full(size, 1.0 / size)
    for i in points:
        bell = np.exp(-0.5 * ((at - i) / width) ** 2)
        out += bell / bell.sum()
    return out / out.sum()


def ask(tried: list[tuple[tuple[int, ...], float | None]], sizes: list[int], n: int, g: np.random.Generator, even: int = 10, candidates: int = 24) -> list[tuple[int, ...]]:
    """``n`` settings (places of values) after those ``tried`` with their worth (none: no result).

    The first ``even`` are drawn evenly. Then each parameter's best quarter and the rest make a density each; of candidates from
    the first the one that is likeliest in it against the second is taken. Settings without a result count among the rest.
    """
    if len(tried) < even:
        return [tuple(int(g.integers(k)) for k in sizes) for _ in range(n)]
    worth = lambda x: -np.inf if x[1] is None else x[1]
    order = sorted(tried, key=worth, reverse=True)
    split = max(1, min(sum(np.isfinite(worth(x)) for x in tried), -(-len(tried) // 4)))
    out = []
    for _ in range(n):
        one = []
        for k, size in enumerate(sizes):
            good, rest = parzen([x[0][k] for x in order[:split]], size), parzen([x[0][k] for x in order[split:]], size)
            drawn = g.choice(size, candidates, p=good)
            one.append(int(drawn[np.argmax(good[drawn] / rest[drawn])]))
        out.append(tuple(one))
    return out


def proposals(series: DataFrame, history: DataFrame | None, first: int, n: int, seed: int = 42, space: Mapping[str, tuple] = SPACE, warm: DataFrame | None = None, by: str = KEY) -> DataFrame:
    """``study_trial`` from ``first`` on and ``n`` settings for every series, each by its own ``history`` (at most a study's trials a series).

    ``warm`` (``by``, ``place`` and parameters) gives a series' first settings, moved onto the steps of the space.
    """
    values, names = grid(space), list(space)
    sizes = [len(v) for v in values.values()]
    row = F.struct(*[F.col(k).cast("double").alias(k) for k in names], "value")
    rows = series.select(F.col(by).cast("string").alias(by)).distinct()
    known = history.groupBy(by).agg(F.collect_list(row).alias("tried")) if history is not None else None
    rows = rows.join(known, by, "left") if known is not None else rows.withColumn("tried", F.lit(None).cast(f"array<struct<{','.join(f'{k}: double' for k in names)}, value: double>>"))
    start = F.struct("place", *[F.col(k).cast("double").alias(k) for k in names])
    own = warm.groupBy(F.col(by).cast("string").alias(by)).agg(F.array_sort(F.collect_list(start)).alias("warm")) if warm is not None else None
    rows = rows.join(own, by, "left") if own is not None else rows.withColumn("warm", F.lit(None).cast(f"array<struct<place: int, {', '.join(f'{k}: double' for k in names)}>>"))
    nearest = lambda k, x: min(range(len(values[k])), key=lambda i: abs(values[k][i] - x))

    def run(batches):
        for batch in batches:
            out = []
            for key, tried, begun in zip(*(batch.column(c).to_pylist() for c in (by, "tried", "warm")), strict=True):
                g = np.random.default_rng([seed, first, zlib.crc32(key.encode())])
                told = [(tuple(nearest(k, x[k]) for k in names), x["value"]) for x in tried or []]
                told.sort(key=lambda x: (x[0], x[1] is None, x[1] or 0.0))
                begin = [tuple(nearest(k, w[k]) if w[k] is not None else int(g.integers(len(values[k]))) for k in names) for w in (begun or [])][first : first + n]
                for i, s in enumerate(begin + ask(told, sizes, n - len(begin), g)):
                    out.append((key, first + i, *(float(values[k][j]) for k, j in zip(names, s, strict=True))))
            kinds = [pa.string(), pa.int32(), *[pa.float64()] * len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], [by, "study_trial", *names])

    return rows.mapInArrow(run, f"{by} string, study_trial int, " + ", ".join(f"{k} double" for k in names))


def evaluated(df: DataFrame, settings: DataFrame, inputs: list[str], output: str = "y", train: float = 0.6, by: str = KEY, at: str = AT) -> DataFrame:
    """``settings`` with the best structure on the windows that each selects: ``na, nb, ridge, free_run_fit, value`` and ``state`` (complete,
    pruned where no model is stable, failed where there is none), in one job keyed by series and trial.

    What settings share is derived once a series: anomalies, the regressor, window sums of all sizes; once a series and size: the
    windows' quality. Of a series only the copies that the structure search reads are one a trial.
    """
    df = kept(df.select(F.col(by).cast("string").alias(by), at, output, *inputs))
    trials = kept(settings.withColumn("key", F.concat_ws("\u0001", by, "study_trial")).withColumn("size", F.col("window").cast("long")))
    sizes = sorted(r["size"] for r in trials.select("size").distinct().collect())  # as many as the space has
    delays = sorted(int(r.nk) for r in trials.select("nk").distinct().collect())
    part = kept(regressor.chronological(df, 0.0, train, by, at))
    s = regressor.Structure.of(inputs, 2, 2)
    rows = kept(regressor.regressor(part, s, output, by, at))
    grams = selection.window_grams(rows, s.features, [(x, x // 2) for x in sizes], by)
    marked = rows.select(by, at, "row").join(regressor.with_anomalies(part, [*inputs, output], by=by, at=at), [by, at])
    each = F.concat_ws("\u0001", by, "size").alias("cell")
    used = trials.select(by, "size").distinct()
    n = rows.groupBy(by).agg((F.max("row") + 1).alias("__n"))
    stride = F.floor(F.col("size") / 2)
    held = marked.join(used, by).join(n, by)
    lo = F.greatest(F.lit(0), F.ceil((F.col("row") - F.col("size") + 1) / stride))
    hi = F.least(F.floor(F.col("row") / stride), F.floor((F.col("__n") - F.col("size")) / stride))
    held = held.withColumns({"__lo": lo, "__hi": hi}).filter((F.col("__n") >= F.col("size")) & (F.col("__lo") <= F.col("__hi"))).withColumn("window", F.explode(F.sequence("__lo", "__hi")))
    sigma = used.join(noise_sigma(part, output, by, at), by).select(each, "noise_sigma")
    quality = regressor.window_quality(held.select(each, at, "window", output, *inputs, *[f"anomaly_{c}" for c in [*inputs, output]]), inputs, output, sigma, "cell", at)
    quality = quality.join(regressor.activity_reference(quality, "cell"), "cell").withColumn("cell", F.split("cell", "\u0001"))
    quality = quality.select(F.get("cell", 0).alias(by), F.get("cell", 1).cast("long").alias("size"), F.col("window").alias("w"), "missing_ratio", "anomaly_ratio", "snr_db", "input_activity", "reference")
    gate = (F.col("missing_ratio") <= F.col("missing")) & (F.col("anomaly_ratio") <= F.col("anomalies")) & (F.col("snr_db") >= 0) & (F.col("reference") > 0) & (F.col("input_activity") >= F.col("activity") * F.col("reference"))
    passed = trials.select("key", by, "size", "segments", "missing", "anomalies", "activity").join(quality, [by, "size"]).filter(gate).select("key", by, "size", "segments", "w")
    pool = passed.join(grams.select(by, "size", F.col("window").alias("w"), "products"), [by, "size", "w"]).select("key", "size", F.col("w").alias("window"), "products")
    best = selection.informative_of(pool, len(s.features), int(SPACE["segments"][1]), by="key")
    taken = best.join(trials.select("key", by, "segments"), "key").filter(F.col("rank") <= F.col("segments"))
    first = F.col("window") * F.floor(F.col("size") / 2)
    taken = taken.withColumn("row", F.explode(F.sequence(first, first + F.col("size") - 1))).select("key", by, "row").distinct()
    keep = taken.join(rows.select(by, "row", at), [by, "row"]).select("key", at)
    w = Window.partitionBy(by).orderBy(at)
    late = df.select(by, at, output, *[F.array(*[F.lag(u, k).over(w) for k in delays]).alias(u) for u in inputs])
    place = F.array_position(F.array(*[F.lit(k) for k in delays]), F.col("nk").cast("int")) - 1
    copies = late.join(trials.select(by, "key", "nk"), by).select("key", at, output, *[F.get(u, place.cast("int")).alias(u) for u in inputs])
    found = arx.best_trials(arx.search(copies, inputs, output, by="key", at=at, keep=keep), "key")
    out = trials.join(found.select("key", "na", "nb", "ridge", "free_run_fit", F.col("value").alias("worth")), "key", "left").drop("key", "size")
    state = F.when(F.col("worth").isNull(), "failed").when(F.col("worth") == float("-inf"), "pruned").otherwise("complete")
    return out.withColumn("state", state).withColumn("value", F.when(F.col("state") == "complete", F.col("worth"))).drop("worth")


def trials(df: DataFrame, inputs: list[str], n: int = 50, output: str = "y", seed: int = 42, warm: DataFrame | None = None, batch: int = 20, by: str = KEY, at: str = AT) -> DataFrame:
    """A study of ``n`` trials for every series: ``study_trial``, the setting, the best structure on its selection, ``value`` and ``state``.

    Trials are asked for and judged in batches, the first of ten; each series' settings follow from its own trials so far.
    Failed and pruned trials stay, without a value, and draw the sampler away.
    """
    history, done = None, 0
    while done < n:
        size = min(n - done, 10 if not done else batch)
        asked = proposals(df.select(by), history, done, size, seed, warm=warm, by=by)
        got = kept(evaluated(df, asked, inputs, output, by=by, at=at))
        history = got if history is None else history.unionByName(got)
        done += size
    return history


def importance(rows: DataFrame, parameters: list[str], least: int = 4, by: str = KEY, value: str = "value", order: str = "study_trial") -> DataFrame:
    """``parameter, importance``: strength of the correlation between ordinal ranks (ties by trial) of a parameter and the value over complete
    trials, as a share of the sum over parameters; a series with under ``least`` of them has none."""
    w = lambda c: Window.partitionBy(by).orderBy(c, order)
    done = rows.filter(F.col(value).isNotNull()).withColumn("__v", F.row_number().over(w(value)))
    ranks = done.select(by, "__v", *[F.row_number().over(w(p)).alias(p) for p in parameters])
    wide = ranks.groupBy(by).agg(F.count("*").alias("__n"), *[F.coalesce(F.abs(F.corr(p, "__v")), F.lit(0.0)).alias(p) for p in parameters]).filter(F.col("__n") >= least)
    total = sum((F.col(p) for p in parameters), F.lit(0.0))
    return wide.withColumn("__t", total).filter("__t > 0").select(by, F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), (F.col(p) / F.col("__t")).alias("importance")) for p in parameters])).alias("x")).select(by, "x.*")


MEMORY = "dataset string, series string, features array<double>, " + ", ".join(f"{k} double" for k in SPACE) + ", value double"


def remember(rows: DataFrame, prints: DataFrame, path: str, dataset: str, by: str = KEY) -> None:
    """Append each series' fingerprint and best complete setting to the memory at ``path``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("value"), "study_trial"))
    best = rows.filter("state = 'complete'").withColumn("__r", place).filter("__r = 1")
    kept_ = best.join(prints.select(F.col(by).cast("string").alias(by), "features"), by)
    kept_.select(F.lit(dataset).alias("dataset"), F.col(by).alias("series"), "features", *SPACE, "value").write.mode("append").parquet(path)


def warm_start(prints: DataFrame, memory: DataFrame, dataset: str, most: float = 0.35, top: int = 3, by: str = KEY) -> DataFrame:
    """``place`` and parameters of the ``top`` settings remembered from series most like each one, of other datasets only: what a dataset has
    taught before must not come back to it. Series meet in cells as wide as ``most`` over three features."""
    last = len(profile.FEATURES)
    cell = {f"__c{k}": F.floor(F.get("features", last - 1 - k) / most) for k in range(3)}
    own = prints.select(F.col(by).cast("string").alias(by), F.col("features").alias("__f"), *[c.alias(k) for k, c in cell.items()])
    past = memory.filter(F.col("dataset") != dataset).withColumns(cell)
    for c in cell:
        own = own.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    near = own.join(past, list(cell)).withColumn("__d", distance(F.col("__f"), F.col("features"))).filter(F.col("__d") <= most)
    place = F.row_number().over(Window.partitionBy(by).orderBy("__d", "dataset", "series", *SPACE)) - 1
    return near.withColumn("place", place).filter(F.col("place") < top).select(by, "place", *SPACE, F.col("dataset").alias("source"), F.col("__d").alias("distance"))


def persisted(rows: DataFrame, path: str, study: str) -> DataFrame:
    """Write a study's trials into its own partition of the table at ``path``; doing so again replaces them. Returns the study's rows."""
    marked = rows.withColumn("study", F.lit(study))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("study").parquet(path)
    return rows.sparkSession.read.parquet(path).filter(F.col("study") == study)
