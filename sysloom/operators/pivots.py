"""Nearest fingerprints by distances to pivots, exact and without comparing all pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sysloom.functions.scalars import distance

from .keep import kept
from .profile import KEY

#: Points of the bounded sample that pivots and the first radius are taken from, and pivots whose rings are the cells of the join.
SAMPLE, RINGS = 1024, 3


def chosen(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` points (or all that differ) far from one another: each the farthest from those before."""
    out = [points[int(np.linalg.norm(points - points.mean(axis=0), axis=1).argmax())]]
    gap = np.linalg.norm(points - out[0], axis=1)
    while len(out) < n and gap.max() > 0:
        out.append(points[int(gap.argmax())])
        gap = np.minimum(gap, np.linalg.norm(points - out[-1], axis=1))
    return np.array(out)


def first_radius(points: np.ndarray, total: int, top: int, most: float) -> float:
    """A radius that usually holds ``top`` others: the sample's median, scaled to the whole table's density in three dimensions."""
    if len(points) <= top:
        return most
    apart = np.sqrt(np.maximum(0, (points**2).sum(1)[:, None] + (points**2).sum(1) - 2 * points @ points.T))
    usual = float(np.median(np.sort(apart, axis=1)[:, top]))
    return min(most, max(most / 1024, 1.5 * usual * (len(points) / max(total, 1)) ** (1 / 3)))


def nearest(prints: DataFrame, most: float = 0.35, top: int = 3, by: str = KEY, pivots: int = 5, compared: list[int] | None = None, features: list[int] | None = None) -> DataFrame:
    """``other, distance, rank``: the ``top`` series within ``most`` of each one, ties by name.

    Equal fingerprints are one point with its first names. By the triangle inequality two points within r differ by at most r in
    their distances to every pivot, so points meet ring by ring; a point that finds enough names within r is done, for the others r
    doubles, up to ``most``. With ``features``, the values at these places stand for the distances to pivots (two points within r
    differ by at most r in each of them too). ``compared`` gets the number of distances worked out in each round. Fingerprints have one length.
    """
    order = Window.partitionBy("features").orderBy(by)
    named = prints.select(by, "features").filter(F.col(by).isNotNull() & F.col("features").isNotNull())
    firsts = named.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= top + 1).groupBy("features").agg(F.array_sort(F.collect_list(by)).alias("names"))
    sizes = named.groupBy("features").agg(F.count("*").alias("n"))
    points = kept(firsts.join(sizes, "features").withColumn("id", F.xxhash64("features")))
    total = points.count()
    sample = np.array([r.features for r in points.orderBy("id").limit(SAMPLE).select("features").collect()], float)
    lists = "array<struct<distance: double, name: " + prints.schema[by].dataType.simpleString() + ">>"
    if not total:
        return prints.select(by, F.col(by).alias("other"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0)
    if features:
        far = [F.get("features", k) for k in features]
    else:
        far = [distance(F.col("features"), F.array(*[F.lit(float(x)) for x in p])) for p in chosen(sample, pivots)]
    points = kept(points.withColumn("far", F.array(*far)))
    own = F.transform("names", lambda x: F.struct(F.lit(0.0).alias("distance"), x.alias("name")))
    radius, open_, done = first_radius(sample, total, top, most), points, None
    rings = min(RINGS, len(far))
    while True:
        cell = lambda k, r=radius: F.floor(F.get("far", k) / r)
        asked = open_.select(F.col("features").alias("f"), F.col("far").alias("g"), "names", F.col("n").alias("own"), *[cell(k).alias(f"c{k}") for k in range(rings)])
        for k in range(rings):
            asked = asked.withColumn(f"c{k}", F.explode(F.sequence(F.col(f"c{k}") - 1, F.col(f"c{k}") + 1)))
        others = points.select("features", "far", F.col("names").alias("theirs"), "n", *[cell(k).alias(f"c{k}") for k in range(rings)])
        apart = F.zip_with("far", "g", lambda a, b: F.abs(a - b))
        met = asked.join(others, [f"c{k}" for k in range(rings)]).filter(F.array_max(apart) <= radius * (1 + 1e-12) + 1e-12).filter(~(F.col("f") == F.col("features")))
        met = met.withColumn("d", distance(F.col("f"), F.col("features")))
        if compared is not None:
            compared.append(met.count())
        near = met.filter(F.col("d") <= radius)
        found = near.select("f", "n", F.posexplode("theirs").alias("__p", "name"), "d").withColumn("__r", F.row_number().over(Window.partitionBy("f").orderBy("d", "name"))).filter(F.col("__r") <= top + 1)
        best = found.groupBy("f").agg(F.collect_list(F.struct(F.col("d").alias("distance"), "name")).alias("best"))
        held = near.groupBy("f").agg(F.sum("n").alias("held"))
        got = open_.join(best.join(held, "f"), open_.features == F.col("f"), "left").drop("f")
        got = kept(got.select("features", "far", "names", "n", "id", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce(F.col("best"), F.array().cast(lists)).alias("best")))
        enough = (F.col("held") + F.col("n") - 1 >= top) | F.lit(radius >= most)
        part = got.filter(enough).select("features", F.slice(F.array_sort(F.concat(own, "best")), 1, top + 1).alias("best"))
        done = part if done is None else done.unionByName(part)
        if radius >= most:
            break
        open_ = kept(got.filter(~enough).select("features", "far", "names", "n", "id"))
        if open_.isEmpty():
            break
        radius = min(most, 2 * radius)
    rows = named.join(done, "features").withColumn("best", F.slice(F.filter("best", lambda x: x["name"] != F.col(by)), 1, top))
    return rows.select(by, F.posexplode("best").alias("__p", "x")).select(by, F.col("x.name").alias("other"), F.col("x.distance").alias("distance"), (F.col("__p") + 1).alias("rank"))
