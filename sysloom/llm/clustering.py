"""Centroid clustering (Lloyd's rounds) whose vectors mostly keep their cluster without a look at any other centroid.

Every vector carries an upper bound on the distance to its own centroid and a lower bound on the distance to all
others. When centroids have moved, the upper bound grows by the own centroid's drift. The lower bound shrinks by less than the
others' drift: all vectors of a cluster lie in a sphere about its old centroid, and in the plane through that centre and a
moved centroid's old and new place, geometry bounds how much nearer the move can have brought any point of the
sphere (``approach``); a move away from the sphere even raises the bound. Where the bounds meet, the distance to
the own centroid is worked out, and only vectors that stay ambiguous are compared with all centroids.

Components are integers, so distances and means are exact and the bounds, kept in floating point with a margin, only decide
what is looked at. Sums follow the vectors that change their cluster. Each round is one pass over a table of the
shared folder; what reaches the driver is a row for each centroid and component.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import releasing
from .shared import discard, written

#: Largest component, as an integer, for which squared distances fit 64 bits; and for which they are exact in floating point.
LARGEST, FLOATING = 1 << 27, 1 << 21
#: Relative and absolute margin of the bounds, far above the rounding of square roots.
MARGIN = 1e-9
STATE = "vec_id long, v binary, cluster int, was int, near double, other double, scans int"


@dataclass(frozen=True)
class Clustering:
    """``k`` centroids of ``d`` components, ``rounds`` moves, components times ``scale``; seeds by the hash of ``seed:<vec_id>``."""

    k: int = 16
    d: int = 64
    rounds: int = 3
    scale: int = 64
    seed: str = "1"


def approach(old: np.ndarray, new: np.ndarray, centre: np.ndarray, radius: float) -> float:
    """An upper bound of ``|x - old| - |x - new|`` over all x within ``radius`` of ``centre``.

    In the plane through the three points, with the move's midpoint as origin and the move as axis, the sphere is a disc about
    (p, q). A point at an angle a to the axis comes nearer by at most drift * cos(a) if a is acute (the curves of equal
    difference are hyperbolas, which their asymptotes enclose); and by twice the drift times its place along the axis, over the sum of its distances, always.
    """
    half = float(np.linalg.norm(new - old)) / 2
    if half == 0.0:
        return 0.0
    axis, away = (new - old) / (2 * half), centre - (old + new) / 2
    p = float(away @ axis)
    q = float(np.linalg.norm(away - p * axis))
    best, far = 2 * half, float(np.hypot(p, q))
    total = float(np.linalg.norm(centre - old) + np.linalg.norm(centre - new))
    if far > radius:
        nearest = np.arctan2(q, p) - np.arcsin(radius / far)
        if nearest > 0:
            best = min(best, 2 * half * max(0.0, float(np.cos(nearest))))
    reach = p + radius
    if reach <= 0:
        best = min(best, 4 * half * reach / (total + 2 * radius))
    elif total > 2 * radius:
        best = min(best, 4 * half * reach / (total - 2 * radius))
    return best


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, how much nearer any other centroid can have come to a vector of it."""
    out = np.zeros(len(old))
    for i in range(len(old)):
        moves = [approach(old[j], new[j], old[i], float(radius[i])) for j in range(len(old)) if j != i]
        out[i] = max(moves, default=0.0)
    return out


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``v`` from all of ``c`` (int64)."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= FLOATING and v.shape[1] <= 256:
        a, b = v.astype(np.float64), c.astype(np.float64)  # every partial sum below 2**53
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([own_squares(v, np.broadcast_to(row, v.shape)) for row in c], axis=1)


def own_squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = v.astype(np.int64) - c
    return (gap * gap).sum(axis=1)


def integers(vectors: DataFrame, s: Clustering, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, v``: vectors of ``d`` components, none null or non-finite, as little-endian 32-bit integers floor(scale * x)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter((F.size(vector) == s.d) & ~bad).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, s.d)
            whole = np.floor(s.scale * x)
            if np.abs(whole).max(initial=0) > LARGEST:
                raise OverflowError(f"a component beyond {LARGEST // s.scale} has no squared distance of 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * s.d), len(x), [None, pa.py_buffer(whole.astype("<i4").tobytes())]).cast(pa.binary())], ["vec_id", "v"])

    return kept.mapInArrow(run, "vec_id long, v binary")


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, d)


def assigned(state: DataFrame, s: Clustering, centroids: np.ndarray, drift: np.ndarray | None, loose: np.ndarray | None) -> DataFrame:
    """The rows of ``state`` with the nearest of ``centroids`` (ties: the smaller number) and bounds that hold for these."""

    def run(batches):
        for batch in batches:
            v = _rows(batch.column("v"), s.d)
            if drift is None:
                was = np.full(len(v), -1, np.int32)
                cluster, near, other = was.copy(), np.full(len(v), np.inf), np.zeros(len(v))
                scans, unsure = np.zeros(len(v), np.int32), np.arange(len(v))
            else:
                was = batch.column("cluster").to_numpy()
                cluster = was.copy()
                near = (batch.column("near").to_numpy() + drift[was]) * (1 + MARGIN) + MARGIN
                other = (batch.column("other").to_numpy() - loose[was]) * (1 - MARGIN) - MARGIN
                scans = batch.column("scans").to_numpy().copy()
                met = np.flatnonzero(near >= other)
                near[met] = np.sqrt(own_squares(v[met], centroids[was[met]])) * (1 + MARGIN) + MARGIN
                unsure = met[near[met] >= other[met]]
            if len(unsure):
                all_of = squares(v[unsure], centroids)
                first = all_of.argmin(axis=1)
                here = np.arange(len(unsure))
                cluster[unsure], near[unsure] = first, np.sqrt(all_of[here, first]) * (1 + MARGIN) + MARGIN
                all_of[here, first] = np.iinfo(np.int64).max
                other[unsure] = np.sqrt(all_of.min(axis=1)) * (1 - MARGIN) - MARGIN
                scans[unsure] += 1
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *map(pa.array, (cluster, was, near, other, scans))], ["vec_id", "v", "cluster", "was", "near", "other", "scans"])

    return state.mapInArrow(releasing(run), STATE)


def _changes(state: DataFrame, s: Clustering) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By cluster: change of the count, change of the component sums, radius about the present centroid."""

    def run(batches):
        n, sums, radius = np.zeros(s.k, np.int64), np.zeros((s.k, s.d), np.int64), np.zeros(s.k)
        for batch in batches:
            cluster, was = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            np.maximum.at(radius, cluster, batch.column(3).to_numpy())
            moved = np.flatnonzero(cluster != was)
            if not len(moved):
                continue
            v = _rows(batch.column(0).take(pa.array(moved)), s.d).astype(np.int64)
            for c in np.unique(cluster[moved]).tolist():
                there = cluster[moved] == c
                n[c] += there.sum()
                sums[c] += v[there].sum(axis=0)
            for c in np.unique(was[moved]).tolist():
                if c >= 0:
                    gone = was[moved] == c
                    n[c] -= gone.sum()
                    sums[c] -= v[gone].sum(axis=0)
        table = np.concatenate((sums, n[:, None]), axis=1)
        c, j = np.indices(table.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(table.ravel()), pa.array(np.repeat(radius, s.d + 1))], ["c", "j", "change", "radius"])

    parts = state.select("v", "cluster", "was", "near").mapInArrow(releasing(run), "c int, j int, change long, radius double")
    got = parts.groupBy("c", "j").agg(F.sum("change").alias("change"), F.max("radius").alias("radius")).toArrow()
    table, radius = np.zeros((s.k, s.d + 1), np.int64), np.zeros(s.k)
    c = got["c"].to_numpy()
    table[c, got["j"].to_numpy()] = got["change"].to_numpy()
    radius[c] = got["radius"].to_numpy()
    return table[:, s.d], table[:, : s.d], radius


def clustered(vectors: DataFrame, s: Clustering = Clustering(), vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, scans`` (squared distance; rounds in which all centroids were looked at), and the centroids.

    Vectors that are null, have another number of components, or hold a null or non-finite one take no part. With fewer than ``k``
    vectors there are as many centroids as vectors, with none no rows come out. Repeated rows are vectors of their own; null ids
    come last among the seeds, equal hashes in the order of their vectors. Components beyond 2**27 once scaled are an error.
    """
    spark = vectors.sparkSession
    data = written(integers(vectors, s, vec_id, vector), "vectors")
    order = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = data.orderBy(order.asc_nulls_last(), "v").limit(s.k).collect()
    if not seeds:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, scans int"), np.zeros((0, s.d), np.int64)
    centroids = np.stack([np.frombuffer(r.v, "<i4") for r in seeds]).astype(np.int64)
    s = Clustering(len(centroids), s.d, s.rounds, s.scale, s.seed)
    count, sums, drift, loose = np.zeros(s.k, np.int64), np.zeros((s.k, s.d), np.int64), None, None
    for _ in range(s.rounds):
        state = written(assigned(data, s, centroids, drift, loose), "clusters")
        discard(data)
        more, change, radius = _changes(state, s)
        count, sums, data = count + more, sums + change, state
        moved = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], centroids)
        drift = np.linalg.norm((moved - centroids).astype(np.float64), axis=1)
        loose = loosening(centroids.astype(np.float64), moved.astype(np.float64), radius)
        centroids = moved
    final = assigned(data, s, centroids, drift, loose)

    def distances(batches):
        for batch in batches:
            exact = own_squares(_rows(batch.column("v"), s.d), centroids[batch.column("cluster").to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(exact), batch.column("scans")], ["vec_id", "cluster", "distance", "scans"])

    out = written(final.mapInArrow(releasing(distances), "vec_id long, cluster int, distance long, scans int"), "clustered")
    discard(data)
    return out, centroids


def with_inertia(out: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``clustered``'s rows with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``, a row a centroid joined to each vector."""
    by_cluster = {r.cluster: r.total for r in out.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [(c, by_cluster.get(c, 0), sum(by_cluster.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    told = out.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
