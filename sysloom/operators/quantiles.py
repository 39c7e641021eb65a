"""Exact percentiles of groups of any size: a sketch brackets the ranks, counts settle where they lie, and only the brackets are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keep import kept, spread
from .profile import KEY

#: Half the width of a first bracket, as a share of a group's values, and the accuracy of the sketches.
MARGIN, ACCURACY = 0.001, 4000
#: Cells that a bracket is cut into on every further pass.
CELLS = 64


def _inside(v: Column, lo: Column, hi: Column) -> Column:
    """``lo < v <= hi``, where a missing end is open."""
    return (lo.isNull() | (v > lo)) & (hi.isNull() | (v <= hi))


def _brackets(rows: DataFrame, shares: list[float], by: str) -> DataFrame:
    """``i, place, lo, hi, before`` of every share's rank in every group: ``place`` is the (broken) rank from 0, and both whole ranks
    next to it are among the values in ``(lo, hi]``, ``before`` values being at most ``lo``."""
    asked = [min(1.0, max(0.0, s + d)) for s in shares for d in (-MARGIN, MARGIN)]
    ends = rows.groupBy(by).agg(F.percentile_approx("__v", asked, ACCURACY).alias("__e"), F.count("*").alias("__n"))
    ends = kept(ends)
    under = [F.count_if(F.col("__v") <= F.get("__e", F.lit(j))).alias(f"__c{j}") for j in range(len(asked))]
    # arrays are joined again, not aggregated: an aggregate with an array in its buffer sorts all rows
    counts = rows.join(spread(ends), by).groupBy(by).agg(*under).join(spread(ends), by)
    each = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("__n") - 1)
        first, last = F.floor(place), F.ceil(place)
        low, high = F.col(f"__c{2 * i}"), F.col(f"__c{2 * i + 1}")
        at = lambda j: F.get("__e", F.lit(j))
        # an end that the sketch has put on the wrong side of a rank is left open or moved to the other end
        lo = F.when(first >= high, at(2 * i + 1)).when(first >= low, at(2 * i))
        hi = F.when(last < low, at(2 * i)).when(last < high, at(2 * i + 1))
        before = F.when(first >= high, high).when(first >= low, low).otherwise(F.lit(0))
        each.append(F.struct(F.lit(i).alias("i"), place.alias("place"), lo.alias("lo"), hi.alias("hi"), before.cast("long").alias("before")))
    return counts.select(by, F.explode(F.array(*each)).alias("b")).select(by, "b.*")


def _held(rows: DataFrame, brackets: DataFrame, by: str) -> DataFrame:
    """Every value with each bracket of its group that holds it, equal values as one row with their number ``m``."""
    found = F.filter("__b", lambda b: _inside(F.col("__v"), b["lo"], b["hi"]))
    packed = kept(brackets.groupBy(by).agg(F.collect_list(F.struct("i", "place", "lo", "hi", "before")).alias("__b")))  # as many as there are shares
    return rows.join(spread(packed), by).select(by, "__v", F.explode(found).alias("b")).groupBy(by, "b.i", "__v").agg(F.count("*").alias("m"))


def _narrowed(held: DataFrame, brackets: DataFrame, by: str) -> DataFrame:
    """Brackets cut to the cells, of about equal numbers of distinct values, that hold the ranks."""
    keys = [by, "i"]
    points = [j / CELLS for j in range(1, CELLS)]
    cuts = kept(held.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("__v", points, ACCURACY)).alias("cuts")))
    cell = F.size(F.filter("cuts", lambda x: x < F.col("__v")))
    cells = held.join(spread(cuts), keys).withColumn("cell", cell).groupBy(*keys, "cell").agg(F.sum("m").alias("m")).join(spread(cuts), keys)
    so_far = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # CELLS rows at most
    cells = cells.withColumn("upto", F.sum("m").over(so_far)).join(brackets, keys)
    start, stop = F.col("before") + F.col("upto") - F.col("m"), F.col("before") + F.col("upto")
    wanted = (start <= F.ceil("place")) & (stop > F.floor("place"))
    one = cells.filter(wanted).groupBy(*keys).agg(F.min("cell").alias("a"), F.max("cell").alias("z"), F.min(start).alias("b"), F.max("cuts").alias("cuts"), F.max("place").alias("place"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    lo = F.when(F.col("a") == 0, F.col("lo")).otherwise(F.get("cuts", F.col("a") - 1))
    hi = F.when(F.col("z") >= F.size("cuts"), F.col("hi")).otherwise(F.get("cuts", F.col("z")))
    return one.select(*keys, "place", lo.alias("lo"), hi.alias("hi"), F.col("b").alias("before"))


def exact(df: DataFrame, shares: list[float], value: str = "v", by: str = KEY, passes: int = 2, straight: bool = False) -> DataFrame:
    """``q``: the exact percentiles of each group's values at ``shares``, interpolated as ``F.percentile`` does, or if ``straight`` as
    the lower value and a share of the step to the upper one (SQL's ``quantile_cont``; the last bit may differ).

    ``F.percentile`` holds a group's distinct values in one buffer. Here a sketch of fixed size brackets every rank, exact counts
    tell where the rank lies (so a sketch may err, the result doesn't), and ``passes - 1`` further passes over what the brackets hold
    cut them by some sixty each. A bracket then holds about one in 30,000 of the distinct values, which a window that spills puts in
    order. Equal values travel as one row and their number. The input is read three times. Nulls don't count; a group
    without values has a null ``q``, and so has a null group its own row; NaN is above all numbers.
    """
    groups = df.select(by).distinct()
    rows = df.filter(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, F.col(value).cast("double").alias("__v"))
    brackets = kept(_brackets(rows, shares, by))
    held = _held(rows, brackets, by)
    for _ in range(passes - 1):
        held = kept(held)
        brackets = kept(_narrowed(held, brackets, by))
        edge = brackets.select(by, "i", "lo", "hi")
        held = held.join(spread(edge), [by, "i"]).filter(_inside(F.col("__v"), F.col("lo"), F.col("hi"))).drop("lo", "hi")
    so_far = Window.partitionBy(by, "i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.withColumn("upto", F.sum("m").over(so_far)).join(spread(brackets), [by, "i"])
    stop = F.col("before") + F.col("upto")
    start, place = stop - F.col("m"), F.col("place")
    on = lambda rank: F.max(F.when((start <= rank) & (stop > rank), F.col("__v")))
    ends = ranked.groupBy(by, "i").agg(on(F.floor(place)).alias("a"), on(F.ceil(place)).alias("z"), F.max("place").alias("place"))
    between = (F.ceil("place") - F.col("place")) * F.col("a") + (F.col("place") - F.floor("place")) * F.col("z")
    if straight:
        between = F.col("a") + (F.col("z") - F.col("a")) * (F.col("place") - F.floor("place"))
    told = ends.select(by, "i", F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(between).alias("x"))
    lists = told.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))
    return groups.join(lists, by, "left")


def statistics(df: DataFrame, value: str = "v", by: str = KEY, places: int = 8) -> DataFrame:
    """As ``profile.statistics``, for groups of any size, rounded as SQL's ``round`` does: the product with a power of ten is rounded, so
    52724.244999999995, which stands for 52724.245, goes up."""
    v, unit = F.col(value), 10.0**places
    tidy = lambda e: F.when(F.abs(e) * unit < 2.0**52, F.round(e * unit) / unit).otherwise(F.round(e, places))
    out = {"mean": F.avg(v), "std": F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)), "min": F.min(v), "max": F.max(v)}
    rows = df.groupBy(by).agg(F.count(v).alias("n"), *[tidy(e).alias(k) for k, e in out.items()])
    q = exact(df, [0.25, 0.5, 0.75], value, by, straight=True).withColumnRenamed(by, "__by")
    rows = rows.join(q, F.col(by).eqNullSafe(F.col("__by")), "left")
    return rows.select(*[c for c in rows.columns if c not in ("q", "__by")], *[tidy(F.get("q", F.lit(i))).alias(k) for i, k in enumerate(("q25", "q50", "q75"))])


def iqr_anomalies(df: DataFrame, value: str = "v", by: str = KEY) -> DataFrame:
    """As ``profile.iqr_anomalies``, for groups of any size."""
    v, q = F.col(value), exact(df, [0.25, 0.75], value, by)
    n = df.groupBy(by).agg(F.count(value).alias("__m"))
    a, z = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    ok = (F.col("__m") >= 4) & (z - a > 1e-8)
    ends = kept(n.join(q, by).select(by, F.when(ok, a - 1.5 * (z - a)).alias("lo"), F.when(ok, z + 1.5 * (z - a)).alias("hi")))
    return df.join(spread(ends), by).groupBy(by).agg(F.count_if((v < F.col("lo")) | (v > F.col("hi"))).alias("n_anomalies"))


def robust_spread(df: DataFrame, value: str = "v", by: str = KEY) -> DataFrame:
    """``median, mad``: the median, and that of the distances from it, for groups of any size."""
    middle = kept(exact(df, [0.5], value, by).select(by, F.get("q", F.lit(0)).alias("median")))
    off = df.join(spread(middle), by).select(by, F.abs(F.col(value) - F.col("median")).alias("__off"))
    return middle.join(exact(off, [0.5], "__off", by).select(by, F.get("q", F.lit(0)).alias("mad")), by, "left")
