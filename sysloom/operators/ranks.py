"""Positions and running values within groups that may be long: ranges of the order are numbered side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keep import kept, spread, stored


def ranged(df: DataFrame, by: str, first: Column, parts: int = 32) -> DataFrame:
    """``df`` with ``__range``: rising ranges of ``first`` (a number) within each group, about ``parts`` of equal size."""
    points = [i / parts for i in range(1, parts)]
    splits = kept(df.groupBy(by).agg(F.percentile_approx(first, points, 1000).alias("__splits")))  # not derived twice: a sketch may differ
    rows = df.join(spread(splits), by).withColumn("__first", first)
    return rows.withColumn("__range", F.size(F.filter("__splits", lambda x: x < F.col("__first")))).drop("__splits", "__first")


def positions(df: DataFrame, by: str, order: list[str], first: Column | None = None, name: str = "row", columns: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: the place of each row within its group, from 1, by ``order``; ``columns`` are those to go on with (all by default).

    ``first`` is no longer needed. Ranges follow the whole order, so equal values of its first column don't share a task, and there are
    as many as shuffle partitions. Numbered rows are stored, since drawing ranges twice could part them elsewhere; the numbers that
    a group's ranges begin with, a small table, make places of them.
    """
    part = F.shiftright("__id", 33)  # monotonically increasing numbers: the partition, then the row in it
    rows = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    rows = stored(rows.select(*(columns or df.columns), F.monotonically_increasing_id().alias("__id")).withColumn("__part", part))
    sizes = rows.groupBy(by, "__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__least"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = kept(sizes.select(by, "__part", (before - F.col("__least") + 1).alias("__start")))
    return rows.join(spread(starts), [by, "__part"]).withColumn(name, F.col("__id") + F.col("__start")).drop("__id", "__part", "__start")


def running_max(df: DataFrame, by: str, order: str, value: str, name: str = "best") -> DataFrame:
    """``df`` with the largest ``value`` so far by ``order`` (a number) in each group: within a range, and over the ranges before."""
    rows = ranged(df, by, F.col(order))
    tops = rows.groupBy(by, "__range").agg(F.max(value).alias("__top"))
    tops = kept(tops.select(by, "__range", F.max("__top").over(Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before")))
    own = F.max(value).over(Window.partitionBy(by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__own", own).join(spread(tops), [by, "__range"]).withColumn(name, F.greatest("__own", "__before")).drop("__own", "__before", "__range")
