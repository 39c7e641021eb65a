"""Least squares and its diagnostics. Sums over rows are Spark aggregates; what is solved has the size of the parameters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .errors import SeriesError
from .profile import KEY


def gram(rows: DataFrame, columns: list[str], by: list[str] | str = KEY) -> DataFrame:
    """Long form ``i, j, value`` (``i <= j``) of the products of ``columns`` summed over the rows of a group, in one pass."""
    keys = [by] if isinstance(by, str) else by
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    wide = rows.groupBy(*keys).agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"__{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"__{i}_{j}").alias("value")) for i, j in pairs])
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.i", "c.j", "c.value")


def triangles(rows: DataFrame, columns: list[str], by: str = KEY) -> DataFrame:
    """``n, r`` for each series: the triangular factor of a QR of ``columns``, from factors of parts (TSQR).

    Every task factors its own rows, so what is shuffled is a few small triangles; unlike sums of products they keep
    small singular values.
    """
    p = len(columns)
    schema = f"{by} string, n long, r array<double>"

    def of(groups) -> pa.RecordBatch:
        keys, ns, rs = zip(*groups, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ns, pa.int64()), pa.array([r.ravel().tolist() for r in rs], pa.list_(pa.float64()))], [by, "n", "r"])

    def part(batches):
        held: dict[str, list] = {}
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), object)
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(float)
            for k in dict.fromkeys(keys.tolist()):
                own = x[keys == k]
                n, r = held.get(k, (0, np.zeros((0, p))))
                held[k] = n + len(own), np.linalg.qr(np.vstack([r, own]), mode="r")
        if held:
            yield of([(k, n, r) for k, (n, r) in held.items()])

    def join(table: pa.Table) -> pa.Table:
        r = np.vstack([np.array(x).reshape(-1, p) for x in table["r"].to_pylist()])
        return pa.Table.from_batches([of([(table[by][0].as_py(), sum(table["n"].to_pylist()), np.linalg.qr(r, mode="r"))])])

    parts = rows.select(F.col(by).cast("string").alias(by), *columns).mapInArrow(part, schema)
    return parts.groupBy(by).applyInArrow(join, schema)


def solved(triangle: DataFrame, features: list[str], by: str = KEY, ridge: float = 0.0) -> DataFrame:
    """``theta, n, rank, condition, rss`` from triangles of ``[features, target]``: minimum-norm least squares, or ridge.

    The rank tolerance is that of the whole matrix: largest singular value times max(n, p) times machine epsilon.
    """
    p = len(features)

    def solve(batches):
        for batch in batches:
            out = []
            for key, n, flat in zip(*(batch.column(c).to_pylist() for c in (by, "n", "r")), strict=True):
                r = np.array(flat).reshape(-1, p + 1)
                a, b = r[:, :p], r[:, p]
                u, s, vt = np.linalg.svd(a, full_matrices=False)
                tol = (s[0] if len(s) else 0) * max(n, p) * np.finfo(float).eps
                rank = int((s > tol).sum())
                if ridge:
                    theta = vt.T @ (s / (s * s + ridge) * (u.T @ b))
                else:
                    theta = vt[:rank].T @ ((u.T @ b)[:rank] / s[:rank])
                rss = float(((b - a @ theta) ** 2).sum())
                condition = float(min(1e12, s[0] / s[-1])) if len(s) == p and s[-1] > 0 else 1e12
                out.append((key, theta.tolist(), n, rank, condition, rss))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.list_(pa.float64()), pa.int64(), pa.int32(), pa.float64(), pa.float64()], strict=True)], [by, "theta", "n", "rank", "condition", "rss"])

    return triangle.mapInArrow(solve, f"{by} string, theta array<double>, n long, rank int, condition double, rss double")


def least_squares(rows: DataFrame, features: list[str], target: str = "target", by: str = KEY, ridge: float = 0.0) -> DataFrame:
    """Coefficients of ``target`` on ``features`` for each series, all penalised alike, without intercept."""
    return solved(triangles(rows, [*features, target], by), features, by, ridge)


def pairs(df: DataFrame, columns: list[str], by: str = KEY) -> DataFrame:
    """``a, b, x, y`` of every pair of columns, on rows where both are present."""
    names = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in names])
    return df.select(by, F.explode(cells).alias("p")).select(by, "p.*").filter("x is not null and y is not null")


def _correlation(x: str, y: str):
    r = F.corr(x, y)
    return F.when(F.count("*") < 3, 0.0).otherwise(F.coalesce(F.when(~F.isnan(r), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))), F.lit(0.0)))


def pearson(df: DataFrame, columns: list[str], by: str = KEY) -> DataFrame:
    """Correlation of every pair over the rows that have both; 0 under three rows or without variance."""
    return pairs(df, columns, by).groupBy(by, "a", "b").agg(_correlation("x", "y").alias("r"))


def spearman(df: DataFrame, columns: list[str], by: str = KEY) -> DataFrame:
    """Correlation of average ranks, ranked on the rows that have both."""
    rows = pairs(df, columns, by)
    keys = [by, "a", "b"]
    for c in ("x", "y"):
        w = Window.partitionBy(*keys)
        rows = rows.withColumn(f"r{c}", F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2)
    return rows.groupBy(*keys).agg(_correlation("rx", "ry").alias("r"))


def correlation_groups(links: DataFrame, threshold: float = 0.9, by: str = KEY) -> DataFrame:
    """``node, grp`` of columns joined by chains of correlations of at least ``threshold``; ``grp`` is the first of its group by name.

    A series has as many links as pairs of columns, so its groups are found in one small task.
    """
    strong = links.filter(F.abs("r") >= threshold).select(F.col(by).cast("string").alias(by), "a", "b")

    def group(table: pa.Table) -> pa.Table:
        head: dict[str, str] = {}

        def first(x: str) -> str:
            while head.setdefault(x, x) != x:
                x = head[x]
            return x

        for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
            lo, hi = sorted((first(a), first(b)))
            head[hi] = lo
        names = sorted(head)
        return pa.table({by: [table[by][0].as_py()] * len(names), "node": names, "grp": [first(x) for x in names]})

    return strong.groupBy(by).applyInArrow(group, f"{by} string, node string, grp string")


def inflation(df: DataFrame, columns: list[str], by: str = KEY) -> DataFrame:
    """``name, vif``: the diagonal of the inverse correlation matrix over complete rows; null (infinite) if it is singular."""
    rows = df.dropna(subset=columns)
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), *[F.corr(a, b).alias(f"__{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j])
    p = len(columns)

    def invert(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                m = np.eye(p)
                for i in range(p):
                    for j in range(i + 1, p):
                        m[i, j] = m[j, i] = row[f"__{i}_{j}"] if row[f"__{i}_{j}"] is not None else np.nan
                ok = row["n"] > p and np.isfinite(m).all() and np.linalg.matrix_rank(m) == p
                vif = np.diag(np.linalg.inv(m)) if ok else [None] * p
                out += [(row[by], c, None if v is None else float(v)) for c, v in zip(columns, vif, strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], [by, "name", "vif"])

    return sums.mapInArrow(invert, f"{by} string, name string, vif double")


def design_condition(df: DataFrame, columns: list[str], by: str = KEY) -> DataFrame:
    """``condition``: largest over smallest singular value of the standardised columns over complete rows; null (infinite) if they are dependent."""
    rows = df.dropna(subset=columns)
    ends = rows.groupBy(by).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    scaled = rows.join(ends, by).select(by, *[((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)).alias(c) for c in columns])

    def measure(batches):
        for batch in batches:
            out = []
            for flat in batch.column(2).to_pylist():
                s = np.linalg.svd(np.array(flat).reshape(-1, len(columns)), compute_uv=False)
                out.append(float(s[0] / s[-1]) if len(s) == len(columns) and s[-1] > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [by, "condition"])

    return triangles(scaled, columns, by).mapInArrow(measure, f"{by} string, condition double")


def advice(vif: DataFrame, groups: DataFrame, present: DataFrame, by: str = KEY, limit: float = 10.0, condition: DataFrame | None = None, condition_limit: float = 30.0) -> DataFrame:
    """``name, action``: in a group of correlated inputs keep the one with most values present (ties: of lower inflation) and drop the
    others, review a lone one of high inflation; without groups, review ``__design__`` where the ``condition`` is high.

    ``present``: ``name, n``, the values present of each input.
    """
    vif, groups, present = (d.withColumn(by, F.col(by).cast("string")) for d in (vif, groups, present))
    rows = vif.join(present, [by, "name"]).join(groups.withColumnRenamed("node", "name"), [by, "name"], "left")
    inflation_ = F.coalesce(F.round("vif", 9), F.lit(float("inf")))
    own = Window.partitionBy(by, "grp").orderBy(F.desc("n"), inflation_, "name")
    first = F.row_number().over(own) == 1
    action = F.when(F.col("grp").isNotNull(), F.when(first, "keep").otherwise("drop")).when(F.col("vif") >= limit, "review").otherwise("keep")
    out = rows.select(by, "name", action.alias("action"))
    if condition is not None:
        high = condition.filter(F.col("condition") >= condition_limit).select(F.col(by).cast("string").alias(by))
        out = out.unionByName(high.join(groups.select(by).distinct(), by, "left_anti").select(by, F.lit("__design__").alias("name"), F.lit("review").alias("action")))
    return out


def excitation(grams: DataFrame, features: list[str], ridge: float = 0.0, by: str = KEY) -> DataFrame:
    """Log-determinant (nats, bits), eigenvalue condition, least eigenvalue, A-criterion and rank of information matrices in long form.

    The rank is that of the rows behind the matrix: eigenvalues above the largest times p times machine epsilon, without the ridge.
    """
    if ridge < 0:
        raise SeriesError("PARAMETER_OUT_OF_RANGE", "ridge must not be negative")
    p = len(features)
    cells = grams.groupBy(by).agg(F.collect_list(F.struct("i", "j", "value")).alias("cells"))  # p(p+1)/2 of them

    def measure(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                m = ridge * np.eye(p)
                for c in row["cells"]:
                    m[c["i"], c["j"]] += c["value"]
                    if c["i"] != c["j"]:
                        m[c["j"], c["i"]] += c["value"]
                e = np.linalg.eigvalsh(m)
                good = e[0] > 0
                log_det = float(np.log(e).sum()) if good else None
                out.append((row[by], log_det, log_det / np.log(2) if good else None, float(e[-1] / e[0]) if good else None, float(e[0]), float((1 / e).sum()) if good else None, int((e - ridge > max(e[-1] - ridge, 0) * p * np.finfo(float).eps).sum())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.float64()) for c in cols[1:6]], pa.array(cols[6], pa.int32())], [by, "log_det", "bits", "condition", "min_eigenvalue", "a_criterion", "rank"])

    return cells.mapInArrow(measure, f"{by} string, log_det double, bits double, condition double, min_eigenvalue double, a_criterion double, rank int")


def excitation_orders(df: DataFrame, value: str, most: int = 8, tolerance: float = 1e-3, by: str = KEY, at: str = "t") -> DataFrame:
    """``pe_order``: the largest n at which the lagged second moments of the values present are well conditioned.

    One pass sums the products of all lags for every n.
    """
    w = Window.partitionBy(by).orderBy(at)
    rows = df.filter(F.col(value).isNotNull()).select(by, *[F.lag(value, k).over(w).alias(f"__{k}") for k in range(most)])
    moments = [F.sum(F.when(F.col(f"__{n - 1}").isNotNull(), F.col(f"__{i}") * F.col(f"__{j}"))).alias(f"m_{n}_{i}_{j}") for n in range(1, most + 1) for i in range(n) for j in range(i, n)]
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), F.max(F.abs("__0")).alias("top"), F.max("__0").alias("hi"), F.min("__0").alias("lo"), *moments)

    def orders(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                order = 0
                for n in range(1, most + 1):
                    if row["n"] - n + 1 < n + 1 or not row["top"]:
                        break
                    m = np.array([[row[f"m_{n}_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
                    e = np.linalg.eigvalsh(m)
                    if e[-1] <= 0 or e[0] <= tolerance * e[-1]:
                        break
                    order = n
                out.append((row[by], order))
            cols = list(zip(*out, strict=True)) if out else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32())], [by, "pe_order"])

    return sums.mapInArrow(orders, f"{by} string, pe_order int")
