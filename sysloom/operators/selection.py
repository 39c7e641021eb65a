"""D-optimal choice of windows: which of them teach most about the parameters."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keep import kept, released
from .linear import gram
from .profile import KEY


def gain(factor: np.ndarray, addition: np.ndarray) -> float:
    """Growth of the log-determinant of L L' when ``addition`` joins it."""
    half = np.linalg.solve(factor, addition)
    return float(np.linalg.slogdet(np.eye(len(addition)) + np.linalg.solve(factor, half.T).T)[1])


def greedy(grams: dict[int, np.ndarray], rows: dict[int, set[int]], p: int, ridge: float, windows: int | None, row_budget: int | None, least_bits: float) -> tuple[list[tuple[int, float, float]], int]:
    """(window, gain in nats, log-determinant so far), best first, and how many gains were worked out.

    Gains only shrink as windows join, so an old gain bounds the new one: the top of the heap is worked out
    again, and taken if it stays on top. The first window is always admitted; the first that breaks the row
    budget ends the choice. Ties go to the smaller number.
    """
    information = ridge * np.eye(p)
    level, chosen, covered = p * np.log(ridge), [], set()
    factor = np.linalg.cholesky(information)
    heap = [(-gain(factor, g), k, 0) for k, g in grams.items()]
    heapq.heapify(heap)
    looked = len(heap)
    while heap and (windows is None or len(chosen) < windows):
        bound, k, seen = heapq.heappop(heap)
        if seen < len(chosen):
            heapq.heappush(heap, (-gain(factor, grams[k]), k, len(chosen)))
            looked += 1
            continue
        if -bound <= least_bits * np.log(2):
            break
        if row_budget is not None and chosen and len(covered | rows[k]) > row_budget:
            break
        level -= bound
        covered |= rows[k]
        information = information + grams[k]
        factor = np.linalg.cholesky(information)
        chosen.append((k, -bound, level))
    return chosen, looked


def products(features: list[str]) -> list[tuple[int, int]]:
    """Places of the upper triangle of a matrix of ``features``, row by row."""
    return [(i, j) for i in range(len(features)) for j in range(i, len(features))]


def window_grams(rows: DataFrame, features: list[str], grid: list[tuple[int, int]], by: str = KEY, row: str = "row", block: int = 512) -> DataFrame:
    """``size, window, lo, hi, products``: sums of products of ``features`` over the rows of every window ``[k * stride, k * stride + size)``, for
    every (size, stride) of ``grid``, in one pass over ``rows``.

    Rows are summed once, by units that all sizes and strides are multiples of. Running sums of the units within blocks then
    give any window as a difference of two of them (or the rest of one block and the start of the next), so a sweep's cost does
    not grow with its windows' overlap, and what cancels is no more than a block.
    """
    unit, pairs = math.gcd(*[x for pair in grid for x in pair]), products(features)
    block = max(block, -(-max(size for size, _ in grid) // unit))
    sums = rows.groupBy(by, F.floor(F.col(row) / unit).alias("u")).agg(*[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"__{i}_{j}") for i, j in pairs], F.max(row).alias("__last"))
    w = Window.partitionBy(by, "blk").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("blk", F.floor(F.col("u") / block))
    running = kept(sums.select(by, "u", "blk", "__last", F.array(*[F.sum(f"__{i}_{j}").over(w) for i, j in pairs]).alias("c")))
    whole = running.groupBy(by, "blk").agg(F.max_by("c", "u").alias("t"))
    n = running.groupBy(by).agg((F.max("__last") + 1).alias("__n"))
    every = n.select(by, "__n", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("size"), F.lit(b).cast("long").alias("stride")) for a, b in grid])).alias("g")).select(by, "g.*", F.floor((F.col("__n") - F.col("g.size")) / F.col("g.stride")).alias("top")).filter("top >= 0")
    every = every.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / 10_000))))  # no row holds a long series' windows
    every = every.withColumn("window", F.explode(F.sequence(F.col("__k") * 10_000, F.least("top", (F.col("__k") + 1) * 10_000 - 1))))
    lo = F.col("window") * F.col("stride")
    every = every.select(by, "size", "window", lo.alias("lo"), (lo + F.col("size") - 1).alias("hi"), (F.floor((lo + F.col("size")) / unit) - 1).alias("u_hi"), (F.floor(lo / unit) - 1).alias("u_lo"))
    upper = running.select(by, F.col("u").alias("u_hi"), F.col("blk").alias("b_hi"), F.col("c").alias("c_hi"))
    lower = running.select(by, F.col("u").alias("u_lo"), F.col("blk").alias("b_lo"), F.col("c").alias("c_lo"))
    out = every.join(upper, [by, "u_hi"]).join(lower, [by, "u_lo"], "left").join(whole.select(by, F.col("blk").alias("b_lo"), "t"), [by, "b_lo"], "left")
    less = F.zip_with("c_hi", "c_lo", lambda a, b: a - b)
    more = F.zip_with("c_hi", F.zip_with("t", "c_lo", lambda a, b: a - b), lambda a, b: a + b)
    value = F.when(F.col("c_lo").isNull(), F.col("c_hi")).when(F.col("b_lo") == F.col("b_hi"), less).otherwise(more)
    return out.select(by, "size", "window", "lo", "hi", value.alias("products"))


def informative_of(grams: DataFrame, p: int, windows: int | None = 10, ridge: float = 1e-6, least_bits: float = 0.0, by: str = KEY) -> DataFrame:
    """As ``informative_windows``, from ``window_grams``'s rows, for every series and window size: ``size, window, rank, gain_bits, log_det``."""
    at = [(i, j) for i in range(p) for j in range(i, p)]

    def choose(table: pa.Table) -> pa.Table:
        grams = {}
        for k, flat in zip(table["window"].to_pylist(), table["products"].to_pylist(), strict=True):
            m = np.zeros((p, p))
            for (i, j), x in zip(at, flat, strict=True):
                m[i, j] = m[j, i] = x
            grams[k] = m
        got, _ = greedy(grams, dict.fromkeys(grams, set()), p, ridge, windows, None, least_bits)
        n = len(got)
        return pa.table({by: pa.array([table[by][0].as_py()] * n, pa.string()), "size": pa.array([table["size"][0].as_py()] * n, pa.int64()), "window": pa.array([k for k, _, _ in got], pa.int64()), "rank": pa.array(range(1, n + 1), pa.int32()), "gain_bits": pa.array([g / np.log(2) for _, g, _ in got], pa.float64()), "log_det": pa.array([x for _, _, x in got], pa.float64())})

    rows = grams.select(F.col(by).cast("string").alias(by), "size", "window", "products")
    return rows.groupBy(by, "size").applyInArrow(choose, f"{by} string, size long, window long, rank int, gain_bits double, log_det double")


def informative_windows(held: DataFrame, features: list[str], windows: int | None = 10, row_budget: int | None = None, ridge: float = 1e-6, least_bits: float = 0.0, by: str = KEY) -> DataFrame:
    """``window, rank, gain_bits, log_det, looked, speedup`` of each series' choice from ``held`` (rows with ``row``, ``window`` and features).

    ``looked``: gains worked out for the series; ``speedup``: how many times as many a choice without bounds would have taken.
    Products are summed by window in Spark; the choice within a series sees its windows' small matrices and row ranges.
    """
    p = len(features)
    cells = gram(held, features, [by, "window"]).groupBy(by, "window").agg(F.collect_list(F.struct("i", "j", "value")).alias("cells"))
    spans = held.groupBy(by, "window").agg(F.min("row").alias("lo"), F.max("row").alias("hi"))

    def choose(table: pa.Table) -> pa.Table:
        grams, rows = {}, {}
        for r in table.to_pylist():
            m = np.zeros((p, p))
            for c in r["cells"]:
                m[c["i"], c["j"]] = m[c["j"], c["i"]] = c["value"]
            grams[r["window"]] = m
            rows[r["window"]] = set(range(r["lo"], r["hi"] + 1)) if row_budget is not None else set()
        got, looked = greedy(grams, rows, p, ridge, windows, row_budget, least_bits)
        key = table[by][0].as_py()
        return pa.table({by: pa.array([key] * len(got), pa.string()), "window": pa.array([k for k, _, _ in got], pa.int64()), "rank": pa.array(range(1, len(got) + 1), pa.int32()), "gain_bits": pa.array([g / np.log(2) for _, g, _ in got], pa.float64()), "log_det": pa.array([x for _, _, x in got], pa.float64()), "looked": pa.array([looked] * len(got), pa.int64()), "speedup": pa.array([sum(len(grams) - i for i in range(len(got))) / max(1, looked)] * len(got), pa.float64())})

    every = cells.join(spans, [by, "window"]).withColumn(by, F.col(by).cast("string")).withColumn("window", F.col("window").cast("long"))
    return every.groupBy(by).applyInArrow(choose, f"{by} string, window long, rank int, gain_bits double, log_det double, looked long, speedup double")


def gains(factors: np.ndarray, additions: np.ndarray) -> np.ndarray:
    """``gain`` of many (factor, addition) pairs at once."""
    half = np.swapaxes(np.linalg.solve(factors, additions), 1, 2)
    return np.linalg.slogdet(np.eye(additions.shape[1]) + np.swapaxes(np.linalg.solve(factors, half), 1, 2))[1]


def _square(flat: np.ndarray, p: int) -> np.ndarray:
    """Symmetric matrices from rows of upper triangles."""
    i, j = np.triu_indices(p)
    out = np.zeros((len(flat), p, p))
    out[:, i, j] = out[:, j, i] = flat
    return out


def _with_range(ranges: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    """Disjoint ranges in order, with ``[lo, hi]`` joined to them."""
    apart = [r for r in ranges if r[1] < lo - 1 or r[0] > hi + 1]
    near = [r for r in ranges if r[1] >= lo - 1 and r[0] <= hi + 1]
    return sorted([*apart, (min([lo, *(a for a, _ in near)]), max([hi, *(b for _, b in near)]))])


_STATE = "taken array<long>, gains array<double>, information array<double>, ranges array<struct<lo:long,hi:long>>, floor double, done boolean"


def _head_choice(p: int, ridge: float, windows: int | None, row_budget: int | None, least_bits: float, head: int, by: str):
    """The lazy greedy choice among a series' ``head`` windows of largest bounds, for as long as none outside can come first."""

    def choose(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["window", "lo", "hi", "products", "bound", "seen"]).to_pylist(), key=lambda r: (-r["bound"], r["window"]))
        first = table.slice(0, 1).to_pylist()[0]
        taken, got, ranges = list(first["taken"] or []), list(first["gains"] or []), [(r["lo"], r["hi"]) for r in first["ranges"] or []]
        information = _square(np.array([first["information"]]), p)[0] if first["information"] else ridge * np.eye(p)
        outside = (-rows[head]["bound"], rows[head]["window"]) if len(rows) > head else None
        rows = {r["window"]: r for r in rows[:head]}
        grams = {k: m for k, m in zip(rows, _square(np.array([r["products"] for r in rows.values()]), p), strict=True)}
        heap = [(-r["bound"], k, r["seen"]) for k, r in rows.items()]
        heapq.heapify(heap)
        factor, done, floor = np.linalg.cholesky(information), False, -math.inf
        while True:
            if not heap:
                done = outside is None
                break
            if windows is not None and len(taken) >= windows:
                done = True
                break
            bound, k, seen = heapq.heappop(heap)
            if seen < len(taken):
                heapq.heappush(heap, (-gain(factor, grams[k]), k, len(taken)))
                continue
            if outside is not None and (bound, k) > outside:
                floor = -bound
                break
            if -bound <= least_bits * np.log(2):
                done = True
                break
            joined = _with_range(ranges, rows[k]["lo"], rows[k]["hi"])
            if row_budget is not None and taken and sum(b - a + 1 for a, b in joined) > row_budget:
                done = True
                break
            taken, got, ranges = [*taken, k], [*got, -bound], joined
            information = information + grams[k]
            factor = np.linalg.cholesky(information)
        state = {by: first[by], "taken": taken, "gains": got, "information": information[np.triu_indices(p)].tolist(), "ranges": [{"lo": a, "hi": b} for a, b in ranges], "floor": floor, "done": done}
        fields = [("taken", pa.list_(pa.int64())), ("gains", pa.list_(pa.float64())), ("information", pa.list_(pa.float64())), ("ranges", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("floor", pa.float64()), ("done", pa.bool_())]
        return pa.table({by: pa.array([first[by]], pa.string()), **{k: pa.array([state[k]], t) for k, t in fields}})

    return choose


def spread_choice(grams: DataFrame, p: int, windows: int | None = 10, row_budget: int | None = None, ridge: float = 1e-6, least_bits: float = 0.0, by: str = KEY, head: int = 400) -> DataFrame:
    """``window, rank, gain_bits, log_det``: the choice of ``greedy`` for series of any number of windows.

    ``grams``: ``window, lo, hi, products`` as ``window_grams`` gives them for one size. Windows stay in their partitions with the last gain
    worked out for each, which bounds the present one. In a round a task a series takes the ``head`` windows of largest bounds and
    chooses among them as long as the largest bound outside stays below; then, side by side, only windows whose bounds reach the
    best gain confirmed so far are worked out again. The window of that gain is among them, so each round takes one window at least, and
    usually many. The driver sees one number a round: how many series go on. ``head`` sets memory and rounds, never the result.
    Null products, and windows whose products hold one, take no part.
    """
    if head < 1:
        raise ValueError("head must be at least 1")
    pool = grams.filter(F.col("products").isNotNull() & ~F.exists("products", lambda x: x.isNull() | F.isnan(x)))
    pool = kept(pool.select(F.col(by).cast("string").alias(by), F.col("window").cast("long").alias("window"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "products", F.lit(math.inf).alias("bound"), F.lit(-1).cast("long").alias("seen")))
    start = [0.0] * (p * (p + 1) // 2)
    for i in range(p):
        start[i * p - i * (i - 1) // 2] = ridge
    empty = {"taken": F.array().cast("array<long>"), "gains": F.array().cast("array<double>"), "information": F.array(*map(F.lit, start)), "ranges": F.array().cast("array<struct<lo:long,hi:long>>"), "floor": F.lit(-math.inf), "done": F.lit(False)}
    states = kept(pool.select(by).distinct().select(by, *[c.alias(k) for k, c in empty.items()]))
    columns = [by, "window", "lo", "hi", "products", "bound", "seen"]

    def worked_out(batches):
        for batch in batches:
            bound, floor = batch["bound"].to_numpy(), batch["floor"].to_numpy()
            stale = np.flatnonzero((bound >= floor) & (batch["seen"].to_numpy() < batch["n"].to_numpy()))
            bound, seen = bound.copy(), batch["seen"].to_numpy().copy()
            for lo in range(0, len(stale), 2048):
                at = stale[lo : lo + 2048]
                own = pa.array(at)
                factor, inverse = np.unique(np.array(batch["information"].take(own).to_pylist()), axis=0, return_inverse=True)
                factor = np.linalg.cholesky(_square(factor, p))[inverse.ravel()]
                bound[at] = gains(factor, _square(np.array(batch["products"].take(own).to_pylist()), p))
                seen[at] = batch["n"].to_numpy()[at]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns[:5]), pa.array(bound), pa.array(seen)], columns)

    passed: list[DataFrame] = []
    while states.agg(F.count_if(~F.col("done"))).first()[0]:
        released(*passed)  # what this round's tables were made from
        live = states.filter("not done").select(by, "taken", "information", "floor", F.size("taken").cast("long").alias("n"))
        rest = pool.join(live, by).filter(~F.array_contains("taken", F.col("window"))).drop("taken")
        fresh = kept(rest.mapInArrow(worked_out, pool.schema))
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("bound"), "window"))
        heads = fresh.withColumn("__place", place).filter(F.col("__place") <= head + 1).drop("__place")
        moved = heads.join(states.filter("not done"), by).groupBy(by).applyInArrow(_head_choice(p, ridge, windows, row_budget, least_bits, head, by), f"{by} string, {_STATE}")
        idle = live.join(fresh.select(by).distinct(), by, "left_anti").select(by)  # nothing left to choose from
        ended = states.join(idle, by, "left_semi").withColumn("done", F.lit(True))
        passed = [pool, states]
        states, pool = kept(states.filter("done").unionByName(moved).unionByName(ended)), fresh
    released(*passed, pool)
    level = F.aggregate(F.slice("gains", 1, F.col("rank")), F.lit(p * math.log(ridge)), lambda a, x: a + x)
    out = states.select(by, "gains", F.posexplode("taken").alias("rank", "window")).withColumn("rank", (F.col("rank") + 1).cast("int"))
    return out.select(by, "window", "rank", (F.get("gains", F.col("rank") - 1) / math.log(2)).alias("gain_bits"), level.alias("log_det"))
