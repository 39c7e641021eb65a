"""Running summaries of long series by scan: blocks of a series side by side, then the few block rows in order, then blocks again.

A block's summary (its first and last value present, its outer runs) says all that other blocks need of it, and summaries of
neighbouring blocks join to that of both. So a series of any length is worked on in as many tasks as it has blocks, and only a
row a block meets in order. ``at`` numbers the steps of a series; a block holds ``size`` of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sysloom.functions.scalars import close

from .profile import AT, KEY

SIZE = 100_000


def _block(at: str, size: int) -> Column:
    return F.floor(F.col(at) / size)


def around(df: DataFrame, columns: list[str], by: str = KEY, at: str = AT, size: int = SIZE) -> DataFrame:
    """``df`` with ``<c>__before`` and ``<c>__after`` of every column: step and value (``i``, ``v``) of the last value present up to a
    row and the first from it on; and ``__lo``, ``__hi``, the first and last step of the series."""
    here = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("i"), F.col(c).alias("v")))
    rows = df.withColumn("__block", _block(at, size))
    ends = rows.groupBy(by, "__block").agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"), *[f(here(c)).alias(f"{c}{n}") for c in columns for f, n in ((F.min, "__first"), (F.max, "__last"))])
    own, on, back = Window.partitionBy(by), Window.partitionBy(by).orderBy("__block"), Window.partitionBy(by).orderBy(F.desc("__block"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(by, "__block", F.min("__lo").over(own).alias("__lo"), F.max("__hi").over(own).alias("__hi"), *[F.last(f"{c}__last", True).over(earlier(on)).alias(f"{c}__old") for c in columns], *[F.last(f"{c}__first", True).over(earlier(back)).alias(f"{c}__new") for c in columns])
    near = lambda *order: Window.partitionBy(by, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{c}__before": F.last(here(c), True).over(near(at)) for c in columns})
    rows = rows.withColumns({f"{c}__after": F.last(here(c), True).over(near(F.desc(at))) for c in columns})
    rows = rows.join(carried, [by, "__block"])
    rows = rows.withColumns({f"{c}__before": F.coalesce(f"{c}__before", f"{c}__old") for c in columns} | {f"{c}__after": F.coalesce(f"{c}__after", f"{c}__new") for c in columns})
    return rows.drop("__block", *[f"{c}{n}" for c in columns for n in ("__old", "__new")])


def line(before: Column, after: Column, i: Column, method: str) -> Column:
    """Value at ``i`` between two ends (``i``, ``v``): on the line, or the left or right end's."""
    slope = (after["v"] - before["v"]) / (after["i"] - before["i"])
    return {"linear": before["v"] + slope * (i - before["i"]), "ffill": before["v"], "bfill": after["v"]}[method]


def fill(df: DataFrame, columns: list[str], method: str = "linear", limit: int | None = None, by: str = KEY, at: str = AT, size: int = SIZE) -> DataFrame:
    """``df`` with gaps of at most ``limit`` steps (of any length by default) filled in all ``columns``, as ``cleaning.interpolate`` does it."""
    rows = around(df, columns, by, at, size)
    for c in columns:
        before, after, i = F.col(f"{c}__before"), F.col(f"{c}__after"), F.col(at)
        gap = F.coalesce(after["i"], F.col("__hi") + 1) - F.coalesce(before["i"], F.col("__lo") - 1) - 1
        short = F.lit(True) if limit is None else gap <= limit
        rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).when(short, line(before, after, i, method)))
    return rows.drop("__lo", "__hi", *[f"{c}{n}" for c in columns for n in ("__before", "__after")])


def runs(df: DataFrame, alike: Callable[[Column, Column], Column], value: str = "v", by: str = KEY, at: str = AT, size: int = SIZE) -> DataFrame:
    """``start, stop, length, first`` of all longest runs of rows that are each ``alike`` to the one before.

    Inner runs of a block are whole; the first and last run of each block are joined across blocks where their ends are alike.
    """
    w = Window.partitionBy(by, "__block").orderBy(at)
    rows = df.select(by, at, F.col(value).alias("v")).withColumn("__block", _block(at, size))
    rows = rows.withColumns({"__first": F.row_number().over(w) == 1, "__p": F.lag("v").over(w)})
    fresh = F.col("__first") | ~F.coalesce(alike(F.col("__p"), F.col("v")), F.lit(False))
    rows = rows.withColumn("__run", F.sum(F.when(fresh, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(by, "__block", "__run").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count("*").alias("length"), F.min_by(F.struct("v"), at)["v"].alias("first"), F.max_by(F.struct("v"), at)["v"].alias("last"))
    found = found.withColumn("__edge", (F.col("__run") == 1) | (F.col("__run") == F.max("__run").over(Window.partitionBy(by, "__block"))))
    inner = found.filter("not __edge").select(by, "start", "stop", "length", "first")
    o = Window.partitionBy(by).orderBy("__block", "__run")
    edges = found.filter("__edge").withColumns({"__b": F.lag("__block").over(o), "__l": F.lag(F.struct("last")).over(o)})
    joined = (F.col("__b") != F.col("__block")) & F.coalesce(alike(F.col("__l")["last"], F.col("first")), F.lit(False))
    edges = edges.withColumn("__island", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    outer = edges.groupBy(by, "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("length").alias("length"), F.min_by(F.struct("first"), "start")["first"].alias("first")).drop("__island")
    return inner.unionByName(outer)


def longest_missing_run(df: DataFrame, value: str = "v", by: str = KEY, at: str = AT, size: int = SIZE) -> DataFrame:
    """As ``profile.longest_missing_run``, for series of any length."""
    found = runs(df, lambda a, b: a.isNull() & b.isNull(), value, by, at, size)
    return found.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("first").isNull(), F.col("length"))), F.lit(0)).alias("longest_missing_run"))


def frozen_segments(df: DataFrame, value: str = "v", by: str = KEY, at: str = AT, least: int = 5, size: int = SIZE) -> DataFrame:
    """As ``profile.frozen_segments``, for series of any length."""
    found = runs(df, lambda a, b: close(a, b), value, by, at, size)
    return found.filter(F.col("first").isNotNull() & (F.col("length") >= least)).select(by, "start", "stop", "length")
