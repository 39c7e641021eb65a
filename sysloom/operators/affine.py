"""Free runs of long series, in parallel over time.

Over a block of steps the recursion is an affine map of the last ``na`` outputs before it: a power of the model's companion matrix
and an offset. Blocks work out their maps side by side, a scan over the few maps of a series gives every block the outputs it starts from,
and blocks replay from there. Where values would leave the limits, which a stable model's don't, the map no longer tells; the
stretches in which that happens are stepped through as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import in_blocks
from .keep import kept
from .profile import AT, KEY
from .regressor import Structure


def recur(drive: list[float], a: list[float], state: list[float], limit: float | None) -> tuple[list[float], bool]:
    """Outputs of ``drive[k] - a . (last outputs, latest first)`` from ``state`` (oldest first), held to ``limit``, and whether it was met."""
    out, bit, last = [], False, state[::-1]
    for d in drive:
        x = d - sum(p * q for p, q in zip(a, last))
        if limit is not None and not -limit <= x <= limit and x == x:
            x, bit = (limit if x > 0 else -limit), True
        out.append(x)
        last = [x, *last[:-1]]
    return out, bit


def start(y: list[float], drive: list[float], warm: int, a: list[float], limit: float) -> tuple[list[float], bool]:
    """A stretch's first outputs: ``warm`` measured ones, then the recursion."""
    first = y[:warm]
    rest, bit = recur(drive[warm:], a, first[-len(a) :], limit) if len(first) >= len(a) else ([], False)
    return first + rest, bit


def companion(a: list[float]) -> np.ndarray:
    """Matrix that moves a state (oldest first) on by one step without drive."""
    m = np.eye(len(a), k=1)
    m[-1] = [-x for x in a[::-1]]
    return m


def driven(df: DataFrame, models: DataFrame, s: Structure, output: str, by: str, at: str, size: int, within: str | None) -> DataFrame:
    """Rows with what the inputs add (``drive``), in stretches and blocks of them; lags see ``s.history`` steps of the block before."""
    keyed = df.withColumn(by, F.col(by).cast("string"))
    ends = keyed.groupBy(by).agg(F.min(at).alias("__lo"), F.max(F.abs(output)).alias("__top"))
    rows = in_blocks(keyed.join(models.select(F.col(by).cast("string").alias(by), "theta"), by), s.history, size, by, at)
    w, drive, i = Window.partitionBy(by, "block").orderBy(at), F.lit(0.0), s.na
    for u in s.inputs:
        for k in range(s.nb[u]):
            drive = drive + F.get("theta", i) * F.lag(u, s.nk[u] + k).over(w)
            i += 1
    rows = rows.select(by, at, F.col(output).cast("double").alias("y"), F.slice("theta", 1, s.na).alias("a"), drive.alias("drive"), "own", (F.col(within) if within else F.lit("all")).alias("stretch"))
    rows = rows.filter("own and stretch is not null").drop("own")
    spans = rows.groupBy(by, "stretch").agg(F.min(at).alias("__from"))
    rows = rows.join(ends, by).join(spans, [by, "stretch"])
    warm = F.greatest(F.lit(s.na), F.col("__lo") + s.history - F.col("__from"))  # the first steps of a series, and ``na`` of a stretch, are measured
    limit = 1e3 * F.greatest(F.coalesce("__top", F.lit(1.0)), F.lit(1.0))
    return rows.select(by, "stretch", at, "y", "a", "drive", warm.cast("int").alias("warm"), limit.alias("limit"), F.floor((F.col(at) - F.col("__from")) / size).alias("blk"))


def _read(table: pa.Table, at: str):
    table = table.sort_by(at)
    of = lambda c: table[c].to_numpy().astype(float).tolist()
    return table, of("y"), of("drive"), table["a"][0].as_py(), table["warm"][0].as_py(), table["limit"][0].as_py(), table["blk"][0].as_py()


def free_run(df: DataFrame, models: DataFrame, s: Structure, output: str = "y", by: str = KEY, at: str = AT, within: str | None = None, size: int = 100_000) -> DataFrame:
    """As ``arx.free_run`` (``t, y, simulated``) for ``at`` that numbers the steps: each task steps through ``size`` of them (at least the model's
    history), however long the series."""
    size, na = max(size, s.history + s.na), s.na
    rows = kept(driven(df, models, s, output, by, at, size, within))
    keys, kinds = [by, "stretch"], f"{by} string, stretch {rows.schema['stretch'].dataType.simpleString()}"
    key = lambda table: {k: table[k].slice(0, 1) for k in keys}

    def map_of(table: pa.Table) -> pa.Table:
        table, y, drive, a, warm, limit, blk = _read(table, at)
        if blk == 0:
            out, _ = start(y, drive, warm, a, limit)
            m, c = np.zeros((na, na)), out[-na:]
        else:
            out, _ = recur(drive, a, [0.0] * na, None)
            with np.errstate(over="ignore", invalid="ignore"):
                m = np.linalg.matrix_power(companion(a), len(drive))
            c = ([0.0] * na + out)[-na:]
            if len(out) < na:  # a short last block: no one starts from it
                c = [0.0] * na
        c = [0.0] * (na - len(c)) + list(c)
        return pa.table(key(table) | {"blk": pa.array([blk], pa.int64()), "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64())), "c": pa.array([c], pa.list_(pa.float64()))})

    def scan(table: pa.Table) -> pa.Table:
        table, state, states = table.sort_by("blk"), np.zeros(na), []
        with np.errstate(over="ignore", invalid="ignore"):
            for m, c in zip(table["m"].to_pylist(), table["c"].to_pylist(), strict=True):
                states.append(state.tolist())
                state = np.array(m).reshape(na, na) @ state + np.array(c)
        return pa.table({k: table[k] for k in [*keys, "blk"]} | {"state": pa.array(states, pa.list_(pa.float64()))})

    def replay(table: pa.Table, states: pa.Table) -> pa.Table:
        table, y, drive, a, warm, limit, blk = _read(table, at)
        out, bit = start(y, drive, warm, a, limit) if blk == 0 else recur(drive, a, states["state"][0].as_py(), limit)
        return pa.table({k: table[k] for k in [*keys, at, "y"]} | {"simulated": pa.array(out, pa.float64()), "bit": pa.array([bit] * len(out), pa.bool_())})

    def whole(table: pa.Table) -> pa.Table:
        table, y, drive, a, warm, limit, _ = _read(table, at)
        return pa.table({k: table[k] for k in [*keys, at, "y"]} | {"simulated": pa.array(start(y, drive, warm, a, limit)[0], pa.float64())})

    maps = rows.groupBy(*keys, "blk").applyInArrow(map_of, f"{kinds}, blk long, m array<double>, c array<double>")
    states = maps.groupBy(*keys).applyInArrow(scan, f"{kinds}, blk long, state array<double>")
    out = rows.groupBy(*keys, "blk").cogroup(states.groupBy(*keys, "blk")).applyInArrow(replay, f"{kinds}, {at} long, y double, simulated double, bit boolean")
    out = kept(out)
    bitten = kept(out.filter("bit").select(*keys).distinct())
    if not bitten.isEmpty():
        again = rows.join(bitten, keys, "left_semi").groupBy(*keys).applyInArrow(whole, f"{kinds}, {at} long, y double, simulated double")
        out = out.drop("bit").join(bitten, keys, "left_anti").unionByName(again)
    return out.select(by, at, "y", "simulated")
