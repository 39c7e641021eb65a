"""Input delays: prewhitened correlations propose lags, free-run fits decide."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arx import simulated_fit
from .keep import kept
from .linear import triangles
from .profile import AT, KEY


def cross_correlation(df: DataFrame, u: str, y: str, max_lag: int = 20, by: str = KEY, at: str = AT) -> DataFrame:
    """``lag, r``: correlation of ``u`` with ``y`` that many steps later, centred anew at each lag; 0 under eight pairs. One pass."""
    w = Window.partitionBy(by).orderBy(at)
    rows = df.select(by, F.col(y).alias("y"), *[F.lag(u, k).over(w).alias(f"u{k}") for k in range(max_lag + 1)])
    r = lambda k: F.when(F.count(F.when(F.col(f"u{k}").isNotNull(), F.col("y"))) >= 8, F.coalesce(F.nanvl(F.corr(f"u{k}", "y"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    wide = rows.groupBy(by).agg(*[r(k).alias(f"r{k}") for k in range(max_lag + 1)])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in range(max_lag + 1)])
    return wide.select(by, F.explode(cells).alias("c")).select(by, "c.lag", "c.r")


def peaks(curve: DataFrame, samples: DataFrame, top: int = 3, by: str = KEY) -> DataFrame:
    """``lag, r, confidence, rank``: the strongest local peaks of ``|r|``; ``samples``: ``n`` of each series."""
    w = Window.partitionBy(by).orderBy("lag")
    m = F.abs("r")
    rows = curve.withColumns({"left": F.lag(m).over(w), "right": F.lead(m).over(w)})
    ok = (m > 0) & (m >= F.coalesce("left", F.lit(-1.0))) & (m >= F.coalesce("right", F.lit(-1.0)))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(m), "lag"))
    best = rows.filter(ok).withColumn("rank", rank).filter(F.col("rank") <= top).join(samples, by)
    return best.select(by, "lag", "r", F.least(F.lit(1.0), m * F.sqrt(F.greatest("n", F.lit(1))) / 1.96 / 3).alias("confidence"), "rank")


def ar_models(df: DataFrame, value: str, max_order: int = 20, by: str = KEY, at: str = AT) -> DataFrame:
    """``order, coefficients`` of the autoregression of least AIC for the centred values present.

    Each order has rows of its own, so each has a triangle of its own; one pass makes them all, and they are all that leaves the rows.
    """
    w = Window.partitionBy(by).orderBy(at)
    present = df.filter(F.col(value).isNotNull())
    centred = present.withColumn("x", F.col(value) - F.avg(value).over(Window.partitionBy(by))).withColumn("i", F.row_number().over(w))
    lags = centred.select(F.col(by).cast("string").alias(by), "i", F.col("x").alias("x0"), *[(-F.lag("x", k).over(w)).alias(f"x{k}") for k in range(1, max_order + 1)])
    # the order's rows leave out only its first steps: one row for every order that it serves, and one pass makes all triangles
    width = max_order + 1
    served = F.explode(F.sequence(F.lit(1), F.least(F.lit(max_order), F.col("i") - 1))).alias("p")
    past = F.array(*[F.col(f"x{k}") for k in range(1, width)])
    rows = lags.filter("i > 1").select(by, served, "x0", past.alias("past"))
    rows = rows.select(F.concat_ws("\u0001", by, F.col("p").cast("string")).alias("key"), *[F.when(F.col("p") >= k, F.get("past", k - 1)).otherwise(0.0).alias(f"x{k}") for k in range(1, width)], "x0")
    names = [*(f"x{k}" for k in range(1, width)), "x0"]
    out = triangles(rows, names, "key").select(F.get(F.split("key", "\u0001"), 0).alias(by), F.get(F.split("key", "\u0001"), 1).cast("int").alias("p"), "n", "r")

    def choose(table: pa.Table) -> pa.Table:
        best, key = (np.inf, 0, []), table[by][0].as_py()
        triangles_of = {r["p"]: r for r in table.to_pylist()}
        total = triangles_of[1]["n"] + 1 if 1 in triangles_of else 0
        for p in sorted(triangles_of):
            r = triangles_of[p]
            if total < 8 or p > max(1, total // 10) or r["n"] <= p + 1:
                break
            m = np.array(r["r"]).reshape(-1, width)
            theta = np.linalg.lstsq(m[:, :p], m[:, -1], rcond=None)[0]
            variance = float(((m[:, -1] - m[:, :p] @ theta) ** 2).sum()) / r["n"]
            if variance <= 0:
                best = (-np.inf, p, theta.tolist())
                break
            aic = r["n"] * np.log(variance) + 2 * p
            if aic < best[0]:
                best = (aic, p, theta.tolist())
        return pa.table({by: [key], "order": pa.array([best[1]], pa.int32()), "coefficients": pa.array([best[2]], pa.list_(pa.float64()))})

    return out.groupBy(by).applyInArrow(choose, f"{by} string, order int, coefficients array<double>")


def filtered(df: DataFrame, models: DataFrame, columns: list[str], max_order: int = 20, by: str = KEY, at: str = AT) -> DataFrame:
    """``columns`` centred and passed through each series' autoregression; rows without enough past go."""
    own, w = Window.partitionBy(by), Window.partitionBy(by).orderBy(at)
    rows = df.withColumn(by, F.col(by).cast("string"))
    rows = rows.withColumns({c: F.col(c) - F.avg(c).over(own) for c in columns}).withColumn("__i", F.row_number().over(w))
    rows = rows.withColumns({f"__{c}": F.array(*[F.lag(c, k).over(w) for k in range(1, max_order + 1)]) for c in columns}).join(models, by)
    for c in columns:
        past = F.zip_with("coefficients", F.slice(f"__{c}", 1, F.size("coefficients")), lambda a, x: a * x)
        rows = rows.withColumn(c, F.aggregate(past, F.col(c), lambda s, x: s + x))
    return rows.filter(F.col("__i") > F.col("order")).drop("__i", *[f"__{c}" for c in columns], "order", "coefficients")


def prewhitened(df: DataFrame, u: str, y: str, max_lag: int = 20, max_order: int = 20, by: str = KEY, at: str = AT) -> DataFrame:
    """Cross-correlation after both signals pass the autoregression of the input."""
    models = ar_models(df, u, max_order, by, at)
    return cross_correlation(filtered(df.select(by, at, u, y), models, [u, y], max_order, by, at), u, y, max_lag, by, at)


def widened(lags: list[int], max_lag: int, radius: int = 1) -> list[int]:
    """The lags and their neighbours up to ``max_lag``, in the order of the lags; lag 0 if there is none."""
    out: list[int] = []
    for lag in lags:
        out += [x for x in range(lag - radius, lag + radius + 1) if 0 <= x <= max_lag and x not in out]
    return out or [0]


def refined_fit(y: np.ndarray, inputs: dict[str, np.ndarray], delays: dict[str, int], na: int, nb: int, start: int, stop: int) -> float:
    """Free-run fit on the steps from ``start`` to ``stop`` of the least squares model with these delays on the steps before; minus infinity without one."""
    depth = max([na, *(d + nb - 1 for d in delays.values())])
    lagged = lambda x, k: x[depth - k : len(x) - k] if k else x[depth:]
    columns = [-lagged(y, k) for k in range(1, na + 1)] + [lagged(inputs[u], d + k) for u, d in delays.items() for k in range(nb)]
    x, target = np.column_stack(columns), y[depth:]
    train, sound = np.arange(len(target)) + depth < start, np.isfinite(x).all(axis=1) & np.isfinite(target)
    if (train & sound).sum() <= 2 * x.shape[1]:
        return -np.inf
    theta = np.linalg.lstsq(x[train & sound], target[train & sound], rcond=None)[0]
    first = max(start, depth)
    own = slice(first - depth, stop - depth)
    drive = x[own, na:] @ theta[na:]
    past = y[first - na : first]
    if not (np.isfinite(drive).all() and np.isfinite(past).all()):
        return -np.inf
    whole = np.concatenate((past, y[first:stop]))
    got = simulated_fit(whole, np.concatenate((np.zeros(na), drive)), theta[:na], na, float(np.nanmax(np.abs(y))))
    return -np.inf if got is None or not np.isfinite(got) else got


def descend(space: dict[str, list[int]], score: Callable[[dict[str, int]], float], start: dict[str, int], rounds: int = 4) -> tuple[dict[str, int], float]:
    """Change one delay at a time while that raises the score by over 1e-9, at most ``rounds`` times through the inputs."""
    now, best = dict(start), score(start)
    for _ in range(rounds):
        before = best
        for u, lags in space.items():
            for lag in lags:
                trial = now | {u: lag}
                if lag != now[u] and (value := score(trial)) > best + 1e-9:
                    now, best = trial, value
        if best == before:
            break
    return now, best


def refined(df: DataFrame, inputs: list[str], output: str = "y", max_lag: int = 20, top: int = 3, na: int = 2, nb: int = 2, train: float = 0.6, validation: float = 0.2, max_order: int = 20, most: int = 400, chunk: int = 25, by: str = KEY, at: str = AT) -> DataFrame:
    """``input, peak_lag, delay, validation_fit, uncertain`` of every series: delays proposed by prewhitened correlations on the training
    part, and settled by the free-run fit on the validation part.

    Each of the ``top`` peaks is widened by a step. If all combinations are at most ``most`` they are all tried, ``chunk`` in a
    task; else three tasks a series go down from the first, second and third proposals one delay at a time. Ties go to the first combination.
    ``uncertain``: the two strongest peaks are within 0.05. ``at`` must number the steps of a series.
    """
    n = df.groupBy(by).agg((F.max(at) + 1).alias("n"))
    part = df.join(n, by).filter(F.col(at) < F.floor(F.col("n") * train)).withColumn(by, F.col(by).cast("string"))
    size = part.groupBy(by).agg(F.max(F.floor(F.col("n") * train)).alias("n"))
    found = None
    for place, u in enumerate(inputs):
        curve = prewhitened(part.filter(F.col(u).isNotNull() & F.col(output).isNotNull()), u, output, max_lag, max_order, by, at)
        best = peaks(curve, size, top, by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "lag", "r"))).alias("p"))
        row = size.select(by).join(best, by, "left").select(by, F.lit(place).alias("place"), F.transform("p", lambda x: x["lag"]).alias("lags"), F.transform("p", lambda x: F.abs(x["r"])).alias("sizes"))
        found = row if found is None else found.unionByName(row)
    proposals = kept(found.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "lags", "sizes"))).alias("p")))

    def tasks(batches):
        for batch in batches:
            rows = []
            for key, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                space = [widened(x["lags"] or [], max_lag) for x in p]
                count = int(np.prod([len(x) for x in space]))
                rows += [(key, i, p) for i in range(-(-count // chunk) if count <= most else 3)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], batch.column(1).type)], [by, "task", "p"])

    shape = "array<struct<place:int,lags:array<int>,sizes:array<double>>>"
    work = proposals.select(by, F.col("p").cast(shape).alias("p")).mapInArrow(tasks, f"{by} string, task int, p {shape}")
    rows = df.select(F.col(by).cast("string").alias(by), at, output, *inputs).join(work.select(by, F.col("task").alias("part")), by)
    outcome = f"{by} string, first int, fit double, delays array<int>"

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            key, task, p = left[by][0].as_py(), left["task"][0].as_py(), left["p"][0].as_py()
            right = right.sort_by(at)
            y = right[output].to_numpy(zero_copy_only=False).astype(float)
            signals = {u: right[u].to_numpy(zero_copy_only=False).astype(float) for u in inputs}
            start, stop = int(len(y) * train), int(len(y) * (train + validation))
            space = {u: widened(x["lags"] or [], max_lag) for u, x in zip(inputs, p, strict=True)}
            score = lambda d: refined_fit(y, signals, d, na, nb, start, stop)
            combinations = int(np.prod([len(x) for x in space.values()]))
            if start <= max_lag + na + nb:
                best = (0, -np.inf, [space[u][0] for u in inputs])
            elif combinations <= most:
                best = None
                for number in range(task * chunk, min(combinations, (task + 1) * chunk)):
                    rest, delays = number, {}
                    for u in reversed(inputs):
                        rest, k = divmod(rest, len(space[u]))
                        delays[u] = space[u][k]
                    delays = {u: delays[u] for u in inputs}
                    fit_ = score(delays)
                    if best is None or fit_ > best[1]:
                        best = (number, fit_, list(delays.values()))
            else:
                delays, fit_ = descend(space, score, {u: x[task] if task < len(x) else x[0] for u, x in space.items()})
                best = (task, fit_, [delays[u] for u in inputs])
            out = [(key, *best)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int32(), pa.float64(), pa.list_(pa.int32())], strict=True)], names=[by, "first", "fit", "delays"])

    tried = work.groupBy(by, "task").cogroup(rows.groupBy(by, "part")).applyInArrow(settle, outcome)
    best = tried.groupBy(by).agg(F.min_by(F.struct("fit", "delays"), F.struct(-F.col("fit"), F.col("first"))).alias("b"))
    out = best.join(proposals, by).select(by, "b.*", F.posexplode("p").alias("i", "x"))
    close = F.coalesce(F.get("x.sizes", 0) - F.get("x.sizes", 1) < 0.05, F.lit(False))
    names = F.array(*[F.lit(u) for u in inputs])
    fit_ = F.when(F.col("fit") > float("-inf"), F.col("fit"))
    return out.select(by, F.get(names, F.col("i")).alias("input"), F.coalesce(F.get("x.lags", 0), F.lit(0)).alias("peak_lag"), F.get("delays", F.col("i")).alias("delay"), fit_.alias("validation_fit"), close.alias("uncertain"))
