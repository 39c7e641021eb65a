"""Lagged regressors of multi-input ARX models, and candidate windows over their rows."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sysloom.functions.scalars import finite

from . import cleaning
from .errors import SeriesError
from .profile import AT, KEY, noise_sigma


@dataclass(frozen=True)
class Structure:
    """``na`` output lags, and for every input ``nb`` lags from a delay of ``nk``."""

    na: int
    nb: dict[str, int]
    nk: dict[str, int]

    def __post_init__(self):
        if self.na < 1 or not self.nb or min(self.nb.values()) < 1 or min(self.nk.values()) < 0 or self.nb.keys() != self.nk.keys():
            raise SeriesError("PARAMETER_OUT_OF_RANGE", "orders must be positive and delays not negative")

    @classmethod
    def of(cls, inputs: list[str], na: int = 2, nb: int = 2, nk: int = 0) -> Structure:
        return cls(na, dict.fromkeys(inputs, nb), dict.fromkeys(inputs, nk))

    @property
    def inputs(self) -> list[str]:
        return list(self.nb)

    @property
    def features(self) -> list[str]:
        return [f"a{i}" for i in range(1, self.na + 1)] + [f"b_{u}_{i}" for u in self.nb for i in range(self.nb[u])]

    @property
    def history(self) -> int:
        return max([self.na, *(self.nk[u] + self.nb[u] - 1 for u in self.nb)])


def regressor(df: DataFrame, s: Structure, output: str = "y", by: str = KEY, at: str = AT) -> DataFrame:
    """``target`` and a column a feature (negated outputs, then inputs, by position), on rows where all are finite.

    ``row`` numbers those rows within a series. Lags see ``s.history`` steps back, so they may run in blocks.
    """
    if missing := unknown([output, *s.inputs], df):
        raise SeriesError("INVALID_DATASET_SCHEMA", f"unknown columns {missing}")
    w = Window.partitionBy(by).orderBy(at)
    columns = {f"a{i}": -F.lag(finite(F.col(output)), i).over(w) for i in range(1, s.na + 1)}
    columns |= {f"b_{u}_{i}": F.lag(finite(F.col(u)), s.nk[u] + i).over(w) for u in s.inputs for i in range(s.nb[u])}
    rows = df.select(by, at, finite(F.col(output)).alias("target"), F.row_number().over(w).alias("__i"), *[c.alias(k) for k, c in columns.items()])
    rows = rows.filter(F.col("__i") > s.history).drop("__i").dropna(subset=["target", *columns])
    return rows.withColumn("row", (F.row_number().over(w) - 1).cast("long"))


def chronological(df: DataFrame, start: float, stop: float, by: str = KEY, at: str = AT) -> DataFrame:
    """The steps of each series from its share ``start`` on and before its share ``stop``; never shuffled."""
    n = df.groupBy(by).agg((F.max(at) + 1).alias("__n"))
    return df.join(n, by).filter((F.col(at) >= F.floor(F.col("__n") * start)) & (F.col(at) < F.floor(F.col("__n") * stop))).drop("__n")


def window_rows(rows: DataFrame, size: int, stride: int | None = None, by: str = KEY, row: str = "row") -> DataFrame:
    """Every row with each window ``[k*stride, k*stride+size)`` that holds it; windows past the end don't count."""
    stride = stride or max(1, size // 2)
    n = rows.groupBy(by).agg((F.max(row) + 1).alias("__n"))
    lo = F.greatest(F.lit(0), F.ceil((F.col(row) - size + 1) / stride))
    hi = F.least(F.floor(F.col(row) / stride), F.floor((F.col("__n") - size) / stride))
    held = rows.join(n, by).withColumns({"__lo": lo, "__hi": hi}).filter((F.col("__n") >= size) & (F.col("__lo") <= F.col("__hi")))
    return held.withColumn("window", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi", "__n")


def _mean_square_change(c: str, by: list[str], at: str) -> Column:
    w = Window.partitionBy(*by).orderBy(at)
    last = F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(F.col(c).isNotNull(), F.pow(F.col(c) - last, 2))


@dataclass(frozen=True)
class Gate:
    """Limits of the quality gate."""

    missing: float = 0.20
    anomalies: float = 0.10
    snr_db: float = 0.0
    activity: float = 0.05
    hampel_window: int = 11
    hampel_threshold: float = 3.0

    def __post_init__(self):
        shares = all(0.0 <= x <= 1.0 for x in (self.missing, self.anomalies, self.activity))
        if not shares or self.hampel_window < 3 or self.hampel_window % 2 == 0:
            raise SeriesError("PARAMETER_OUT_OF_RANGE", "shares lie between 0 and 1, the window is odd and at least 3")


def with_anomalies(df: DataFrame, signals: list[str], gate: Gate = Gate(), by: str = KEY, at: str = AT) -> DataFrame:
    """``df`` with ``anomaly_<c>`` of every signal: off the centred median of the whole series, before any window is cut."""
    for c in signals:
        df = cleaning.hampel_gate(df, gate.hampel_window, gate.hampel_threshold, c, by, at).withColumnRenamed("anomaly", f"anomaly_{c}")
    return df


def window_quality(held: DataFrame, inputs: list[str], output: str, sigma: DataFrame, by: str = KEY, at: str = AT) -> DataFrame:
    """Evidence on every window: missing and anomalous shares, signal to noise, activity of inputs and output.

    ``held``: rows with ``window``; a column ``anomaly_<c>`` is counted where there is one. ``sigma``: noise by series.
    Changes are between consecutive values present, and start anew in each window.
    """
    signals, keys = [*inputs, output], [by, "window"]
    held = held.withColumns({f"__d_{c}": _mean_square_change(c, keys, at) for c in signals})
    total = F.count("*") * len(signals)
    flagged = [F.count_if(F.col(f"anomaly_{c}")) for c in signals if f"anomaly_{c}" in held.columns]
    add = lambda cs: sum(cs[1:], cs[0]) if cs else F.lit(0)
    out = held.groupBy(*keys).agg(
        F.min(at).alias("start"), F.max(at).alias("stop"), F.count("*").alias("n_rows"),
        (add([F.count_if(F.col(c).isNull()) for c in signals]) / total).alias("missing_ratio"),
        (add(flagged) / total).alias("anomaly_ratio"),
        add([F.coalesce(F.avg(f"__d_{c}"), F.lit(0.0)) for c in inputs]).alias("input_activity"),
        F.coalesce(F.avg(f"__d_{output}"), F.lit(0.0)).alias("output_activity"),
        F.var_pop(output).alias("__power"), F.count(output).alias("__m"),
    )
    noise = F.col("noise_sigma")
    inf = float("inf")
    snr = F.when((F.col("__m") < 2) | (F.col("__power") <= 0), -inf).when(noise <= 0, inf).otherwise(10 * F.log10(F.col("__power") / (noise * noise)))
    return out.join(sigma.select(by, "noise_sigma"), by).withColumn("snr_db", F.coalesce(snr, F.lit(-inf))).drop("__power", "__m", "noise_sigma")


def activity_reference(quality: DataFrame, by: str = KEY) -> DataFrame:
    """95th percentile of a series' positive window activities; 0 without any."""
    return quality.groupBy(by).agg(F.coalesce(F.percentile(F.when(F.col("input_activity") > 0, F.col("input_activity")), F.lit(0.95)), F.lit(0.0)).alias("reference"))


def gated(quality: DataFrame, gate: Gate = Gate(), by: str = KEY) -> DataFrame:
    """``quality`` with ``reasons`` for rejection and ``accepted`` where there is none."""
    rows = quality.join(activity_reference(quality, by), by)
    ref = F.col("reference")
    tests = {
        "missing_ratio_exceeded": F.col("missing_ratio") > gate.missing,
        "anomaly_ratio_exceeded": F.col("anomaly_ratio") > gate.anomalies,
        "snr_below_threshold": F.col("snr_db") < gate.snr_db,
        "steady_state_segment": (ref > 0) & (F.col("input_activity") < gate.activity * ref),
        "no_input_excitation": ref <= 0,
    }
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return rows.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0).drop("reference")


def gate_windows(df: DataFrame, rows: DataFrame, inputs: list[str], output: str, size: int, stride: int | None = None, gate: Gate = Gate(), by: str = KEY, at: str = AT) -> DataFrame:
    """Quality, ``reasons`` and ``accepted`` of every window over ``rows`` (``by, at, row``), with all evidence read from the whole series ``df``:
    noise, and the anomalies of every input and the output."""
    marked = with_anomalies(df, [*inputs, output], gate, by, at)
    held = window_rows(rows.select(by, at, "row").join(marked, [by, at]), size, stride, by)
    return gated(window_quality(held, inputs, output, noise_sigma(df, output, by, at), by, at), gate, by)


def rejections(gates: DataFrame, by: str = KEY) -> DataFrame:
    """Windows rejected for each reason."""
    return gates.select(by, F.explode("reasons").alias("reason")).groupBy(by, "reason").agg(F.count("*").alias("n"))


#: Weights of the parts of the quality score.
WEIGHTS = {"input_energy": 0.25, "output_energy": 0.20, "snr": 0.20, "response_association": 0.20, "duration": 0.15, "anomaly_ratio": -0.25, "missing_ratio": -0.20, "steady_state": -0.20, "short_segment": -0.10}


def weighted_scores(held: DataFrame, quality: DataFrame, inputs: list[str], output: str, by: str = KEY, at: str = AT, short: int = 30) -> DataFrame:
    """``score`` of every window: weighted parts, energies and the like scaled between the 5th and 95th percentile of a series."""
    keys = [by, "window"]
    w = Window.partitionBy(*keys).orderBy(at)
    steps = held.withColumns({f"__s_{c}": F.col(c) - F.lag(c).over(w) for c in [*inputs, output]})

    def association(u: str) -> Column:
        both = F.col(f"__s_{u}").isNotNull() & F.col(f"__s_{output}").isNotNull()
        r = F.corr(F.when(both, F.col(f"__s_{u}")), F.when(both, F.col(f"__s_{output}")))
        return F.when(F.count_if(both) >= 3, F.coalesce(F.abs(F.when(~F.isnan(r), r)), F.lit(0.0))).otherwise(0.0)

    linked = steps.groupBy(*keys).agg(F.greatest(*[association(u) for u in inputs], F.lit(0.0)).alias("response_association"))
    rows = quality.join(linked, keys).withColumns({"input_energy": F.col("input_activity"), "output_energy": F.col("output_activity"), "duration": F.col("n_rows").cast("double"), "snr": F.when(F.abs("snr_db") < float("inf"), F.col("snr_db")).otherwise(0.0)})
    own = ["input_energy", "output_energy", "snr", "response_association", "duration"]
    ends = rows.groupBy(by).agg(*[F.percentile(c, F.lit(q)).alias(f"__{n}_{c}") for c in own for n, q in (("lo", 0.05), ("hi", 0.95))])
    rows = rows.join(ends, by)
    for c in own:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        rows = rows.withColumn(c, F.when(hi <= lo, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - lo) / (hi - lo)))))
    rows = rows.withColumns({"steady_state": 1.0 - F.col("input_energy"), "short_segment": F.when(F.col("n_rows") < short, 1.0).otherwise(0.0)})
    score = F.lit(0.0)
    for k, weight in WEIGHTS.items():
        score = score + weight * F.col(k)
    return rows.select(*keys, score.alias("score"))


def ranked(scores: DataFrame, score: str = "score", by: str = KEY, budget: int | None = None) -> DataFrame:
    """Windows by falling score, ties by number, with ``rank``; at most ``budget`` of a series."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "window")))
    return out if budget is None else out.filter(F.col("rank") <= budget)


def within_rows(scores: DataFrame, spans: DataFrame, rows: int, score: str = "score", by: str = KEY) -> DataFrame:
    """The windows taken by falling ``score`` (ties by number) as long as the distinct rows of all taken stay within ``rows``; one that would not fit is passed over.

    ``spans``: ``window, lo, hi``, the first and last row. A series' windows, not its rows, meet in a task.
    """
    held = scores.select(F.col(by).cast("string").alias(by), F.col("window").cast("long").alias("window"), F.col(score).cast("double").alias("score")).join(spans.select(F.col(by).cast("string").alias(by), F.col("window").cast("long").alias("window"), "lo", "hi"), [by, "window"])

    def take(table: pa.Table) -> pa.Table:
        taken, out, covered = [], [], 0  # ``taken``: disjoint ranges, in order
        for r in sorted(table.to_pylist(), key=lambda r: (-r["score"], r["window"])):
            lo, hi = r["lo"], r["hi"]
            shared = sum(max(0, min(hi, b) - max(lo, a) + 1) for a, b in taken)
            if covered + hi - lo + 1 - shared > rows:
                continue
            covered += hi - lo + 1 - shared
            apart = [x for x in taken if x[1] < lo - 1 or x[0] > hi + 1]
            near = [x for x in taken if x not in apart]
            taken = sorted([*apart, (min([lo, *(x[0] for x in near)]), max([hi, *(x[1] for x in near)]))])
            out.append((r[by], r["window"], len(out) + 1))
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.int32()], strict=True)], names=[by, "window", "rank"])

    return held.groupBy(by).applyInArrow(take, f"{by} string, window long, rank int")


def unknown(requested: list[str], df: DataFrame) -> list[str]:
    """Columns asked for that ``df`` lacks, in order of name."""
    return sorted(set(requested) - set(df.columns))


def recommendation(rank: Column, total: Column) -> Column:
    """First third strongly recommended, second recommended, the rest to be reviewed."""
    third = lambda k: F.floor(k * total / 3)
    return F.when(rank <= F.greatest(F.lit(1), third(1)), "strongly_recommended").when(rank <= F.greatest(F.lit(2), third(2)), "recommended").otherwise("review")
