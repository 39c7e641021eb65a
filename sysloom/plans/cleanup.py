"""Cleaning as one plan over all columns of wide rows.

Repeated times are settled, rows are put on a regular grid if one is asked for and numbered; then gaps, outliers, their treatment
and smoothing follow. Where gaps have a limit, no stage sees further than a few steps, so the rows are dealt once, to blocks
with as many steps of their neighbours as all stages together see, and all windows of all columns share that exchange and
its order. Gaps without a limit are filled by a scan instead. Each cell carries a mask of what has happened to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysloom.functions.scalars import finite
from sysloom.operators import cleaning, ranks, scans
from sysloom.operators.errors import SeriesError
from sysloom.operators.profile import KEY

#: Bits of a cell's mask.
FILLED, OUTLIER, TREATED, SMOOTHED = 1, 2, 4, 8
CHANGED = FILLED | TREATED | SMOOTHED
#: The choices of each stage.
CHOICES = {
    "duplicates": ("first", "mean"),
    "interpolation": ("linear", "ffill", "bfill", "none"),
    "detector": ("hampel", "iqr", "z_score"),
    "treatment": ("keep", "set_null", "local_median", "linear_interpolate", "clip"),
    "smoothing": ("none", "moving_average", "savitzky_golay"),
}


@dataclass(frozen=True)
class Cleaning:
    """``period``: step of the grid in the unit of the times, none by default. ``limit``: longest gap that is filled, none for any."""

    period: float | None = None
    duplicates: str = "mean"
    interpolation: str = "linear"
    limit: int | None = 10
    detector: str = "hampel"
    treatment: str = "linear_interpolate"
    window: int = 7
    threshold: float = 3.0
    z: float = 3.0
    smoothing: str = "none"
    smoothing_window: int = 5

    def __post_init__(self):
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise SeriesError("PARAMETER_OUT_OF_RANGE", f"{name} is one of {allowed}")
        if (self.period is not None and self.period <= 0) or min(self.window, self.smoothing_window) < 3 or (self.limit is not None and self.limit < 1):
            raise SeriesError("PARAMETER_OUT_OF_RANGE", "period and limit must be positive, windows 3 or more")

    @property
    def reach(self) -> int:
        """Steps that a cell's result depends on, to either side, where gaps have a limit."""
        gaps = (self.limit or 0) + 1
        return gaps * (1 + (self.treatment == "linear_interpolate")) + self.window // 2 + (self.smoothing_window | 1) // 2


def settled(df: DataFrame, columns: list[str], duplicates: str, by: str, at: str, order: str) -> DataFrame:
    """One row a time, with ``n_rows``, the rows it stands for: of numbers the mean of those present or the first, of all else the first, in the order of the file."""
    first = lambda c: F.min_by(F.struct(F.col(c).alias("x")), order)["x"]
    numbers = [(F.avg(finite(F.col(c))) if duplicates == "mean" else finite(first(c))).alias(c) for c in columns]
    others = [first(c).alias(c) for c in df.columns if c not in {by, at, order, *columns}]
    return df.groupBy(by, at).agg(*numbers, *others, F.count("*").alias("n_rows"))


def gridded(df: DataFrame, columns: list[str], period: float, by: str, at: str, size: int = scans.SIZE) -> DataFrame:
    """Rows of a regular grid from each series' first time, with ``i``, the step: means of the numbers present among the rows that a step is
    nearest to, the first of all else that is present. A grid is made block by block, so no row holds one whole."""
    span = df.groupBy(by).agg(F.min(at).alias("__t0"), F.floor((F.max(at) - F.min(at)) / period + 1e-9).cast("long").alias("__last"))
    others = [c for c in df.columns if c not in {by, at, "n_rows", *columns}]
    near = df.join(span, by).withColumn("i", F.floor((F.col(at) - F.col("__t0")) / period + 0.5).cast("long")).filter("i <= __last")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(at)))
    near = near.groupBy(by, "i").agg(*[F.avg(c).alias(c) for c in columns], *[first(c).alias(c) for c in others], F.sum("n_rows").alias("n_rows"))
    blocks = span.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__last") / size))))
    steps = blocks.withColumn("i", F.explode(F.sequence(F.col("__b") * size, F.least(F.col("__last"), (F.col("__b") + 1) * size - 1))))
    time = (F.col("__t0") + F.col("i") * period).cast(df.schema[at].dataType)
    return steps.select(by, "i", time.alias(at)).join(near, [by, "i"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def _renamed(rows: DataFrame, c: str, **names: str) -> DataFrame:
    return rows.withColumnsRenamed({k: f"__{c}_{v}" for k, v in names.items()})


def _detected(rows: DataFrame, columns: list[str], plan: Cleaning, by: str, keys: list[str]) -> DataFrame:
    """``rows`` with ``__<c>_bad``, ``__<c>_m``, ``__<c>_lo`` and ``__<c>_hi``: whether a value is an outlier, its centre and bounds."""
    for c in columns if plan.detector == "hampel" else []:
        rows = _renamed(cleaning.hampel(rows, plan.window, plan.threshold, c, keys, "i"), c, outlier="bad", local_median="m", lo="lo", hi="hi")
    if plan.detector == "hampel":
        return rows
    own, table = rows.filter("own"), []
    for c in columns:
        middle, spread = F.percentile(c, F.lit(0.5)), {"iqr": (F.percentile(c, F.lit(0.25)), F.percentile(c, F.lit(0.75))), "z_score": (F.avg(c), F.stddev_samp(c))}[plan.detector]
        table += [F.count(c).alias(f"__{c}_n"), middle.alias(f"__{c}_m"), spread[0].alias(f"__{c}_a"), spread[1].alias(f"__{c}_b")]
    rows = rows.join(own.groupBy(by).agg(*table), by)
    for c in columns:
        n, a, b = F.col(f"__{c}_n"), F.col(f"__{c}_a"), F.col(f"__{c}_b")
        lo, hi, width = (a - 1.5 * (b - a), b + 1.5 * (b - a), b - a) if plan.detector == "iqr" else (a - plan.z * b, a + plan.z * b, b)
        ok = (n >= 4) & (width != 0)
        rows = rows.withColumns({f"__{c}_lo": F.when(ok, lo), f"__{c}_hi": F.when(ok, hi)})
        bad = (F.col(c) < F.col(f"__{c}_lo")) | (F.col(c) > F.col(f"__{c}_hi"))
        rows = rows.withColumn(f"__{c}_bad", F.coalesce(bad, F.lit(False))).drop(f"__{c}_n", f"__{c}_a", f"__{c}_b")
    return rows


def _treated(c: str, treatment: str) -> Column:
    v, bad, m, lo, hi = (F.col(x) for x in (c, f"__{c}_bad", f"__{c}_m", f"__{c}_lo", f"__{c}_hi"))
    new = {"keep": v, "local_median": m, "clip": F.least(F.greatest(v, lo), hi)}.get(treatment, F.lit(None).cast("double"))
    return F.when(bad, new).otherwise(v)


def cleaned(df: DataFrame, columns: list[str], plan: Cleaning = Cleaning(), by: str = KEY, at: str = "ts", order: str = "ord", size: int = scans.SIZE) -> DataFrame:
    """``df`` cleaned: ``by``, ``i`` (the row's number in its series), ``at``, all columns, ``n_rows`` and for each of ``columns`` ``<c>__raw``,
    its value before cleaning, and ``<c>__mask``, the bits of what happened to it.

    Times are numbers; numbers that are not finite count as missing; ``order`` is the order of the file. Rows are neither lost nor
    made up: ``n_rows`` sums up to the rows of ``df`` but for those past the grid's last step.
    """
    if missing := sorted({*columns, by, at, order} - set(df.columns)):
        raise SeriesError("INVALID_DATASET_SCHEMA", f"unknown columns {missing}")
    rows = settled(df, columns, plan.duplicates, by, at, order)
    if plan.period is not None:
        rows = gridded(rows, columns, plan.period, by, at, size)
    else:
        rows = ranks.positions(rows, by, [at], name="i").withColumn("i", (F.col("i") - 1).cast("long"))
    rows = rows.withColumns({f"{c}__raw": F.col(c) for c in columns})
    keys, bounded = [by, "block"], plan.limit is not None
    block = lambda rows, reach: cleaning.in_blocks(rows, reach, size, by, "i")
    whole = lambda rows: rows.filter("own").drop("block", "own")

    def fill(rows: DataFrame, method: str) -> DataFrame:
        if not bounded:
            return scans.fill(rows, columns, method, None, by, "i", size)
        for c in columns:
            rows = cleaning.interpolate(rows, method, plan.limit, c, keys, "i").drop(c).withColumnRenamed("filled", c)
        return rows

    mask = {c: F.lit(0) for c in columns}

    def marked(rows: DataFrame, bit: int, flags: dict[str, Column]) -> DataFrame:
        return rows.withColumns({f"{c}__mask": F.col(f"{c}__mask").bitwiseOR(F.when(F.coalesce(flags[c], F.lit(False)), bit).otherwise(0)) for c in columns})

    rows = rows.withColumns({f"{c}__mask": m for c, m in mask.items()})
    if bounded:
        rows = block(rows, plan.reach)
    if plan.interpolation != "none":
        rows = fill(rows, plan.interpolation)
        rows = marked(rows, FILLED, {c: F.col(f"{c}__raw").isNull() & F.col(c).isNotNull() for c in columns})
    if not bounded:
        rows = block(rows, plan.window // 2)
    rows = _detected(rows, columns, plan, by, keys)
    rows = marked(rows, OUTLIER, {c: F.col(f"__{c}_bad") for c in columns})
    if plan.treatment != "keep":
        rows = rows.withColumns({f"__{c}_was": F.col(c) for c in columns})
        rows = rows.withColumns({c: _treated(c, plan.treatment) for c in columns})
        if plan.treatment == "linear_interpolate":
            if plan.interpolation == "none":  # gaps are filled only in columns that have an outlier
                some = rows.filter("own").groupBy(by).agg(*[F.max(f"__{c}_bad").alias(f"__{c}_some") for c in columns])
                rows = rows.join(some, by).withColumns({f"__{c}_gap": F.col(c) for c in columns})
            rows = fill(rows if bounded else whole(rows), "linear" if plan.interpolation == "none" else plan.interpolation)
            if plan.interpolation == "none":
                rows = rows.withColumns({c: F.when(F.col(f"__{c}_some"), F.col(c)).otherwise(F.col(f"__{c}_gap")) for c in columns})
            rows = marked(rows, TREATED, {c: F.col(f"__{c}_bad") | F.col(f"__{c}_was").isNull() & F.col(c).isNotNull() for c in columns})
        else:
            rows = marked(rows, TREATED, {c: ~F.col(c).eqNullSafe(F.col(f"__{c}_was")) for c in columns})
    if plan.smoothing != "none":
        if "own" not in rows.columns or not bounded:
            rows = block(whole(rows) if "own" in rows.columns else rows, (plan.smoothing_window | 1) // 2)
        smooth = {"moving_average": cleaning.moving_average, "savitzky_golay": cleaning.savitzky_golay}[plan.smoothing]
        for c in columns:
            rows = _renamed(smooth(rows, plan.smoothing_window, c, keys, "i"), c, smoothed="smooth")
        moved = {c: F.abs(F.col(f"__{c}_smooth") - F.col(c)) > F.greatest(1e-12 * F.greatest(F.abs(f"__{c}_smooth"), F.abs(c)), F.lit(1e-12)) for c in columns}
        rows = marked(rows, SMOOTHED, moved).withColumns({c: F.when(moved[c], F.col(f"__{c}_smooth")).otherwise(F.col(c)) for c in columns})
    if "own" in rows.columns:
        rows = whole(rows)
    others = [c for c in df.columns if c not in {by, at, order, *columns}]
    return rows.select(by, "i", at, *columns, *others, "n_rows", *[f"{c}__{x}" for c in columns for x in ("raw", "mask")])


def changed(mask: Column) -> Column:
    """Whether a cell's value was filled, treated or smoothed."""
    return mask.bitwiseAND(CHANGED) != 0


def summary(rows: DataFrame, columns: list[str], by: str = KEY) -> DataFrame:
    """A row a series and column: cells filled, outliers, treated, smoothed, changed in all, still missing; and rows that times shared."""
    bit = lambda c, b: F.count_if(F.col(f"{c}__mask").bitwiseAND(b) != 0)
    names = {"n_filled": FILLED, "n_outliers": OUTLIER, "n_treated": TREATED, "n_smoothed": SMOOTHED, "n_changed": CHANGED}
    one = [F.struct(F.lit(c).alias("column"), *[bit(c, b).alias(n) for n, b in names.items()], F.count_if(F.col(c).isNull()).alias("n_missing")).alias(f"__{i}") for i, c in enumerate(columns)]
    out = rows.groupBy(by).agg(F.sum(F.greatest(F.col("n_rows") - 1, F.lit(0))).alias("n_duplicates"), *one)
    return out.select(by, "n_duplicates", F.explode(F.array(*[f"__{i}" for i in range(len(columns))])).alias("x")).select(by, "n_duplicates", "x.*")
