import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sysloom.llm.clustering import Clustering, approach, clustered, loosening, squares, with_inertia
from sysloom.llm.queries import op11_clustering, table


def brute(rows, k=16, d=64, rounds=3, scale=64):
    """Plain rounds in Python integers: {vec_id: (cluster, distance)} as a sorted list, centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:k]
    cents = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            group = [v for (_, v), c in zip(kept, own) if c == j]
            if group:
                cents[j] = [sum(x) // len(group) for x in zip(*group)]
    return sorted(((i is None, i or 0, nearest(v)[1], nearest(v)[0]) for i, v in kept)), cents


def same(out, cents, rows, **kw):
    want, centroids = brute(rows, **kw)
    assert cents.tolist() == centroids
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in out.collect()) == want


@settings(deadline=None, max_examples=200)
@given(st.integers(0, 2**32), st.integers(2, 5), st.floats(0.01, 100), st.floats(0, 50))
def test_no_point_of_the_sphere_comes_nearer_than_the_bound(seed, d, spread, radius):
    g = np.random.default_rng(seed)
    old, new, centre = g.normal(size=(3, d)) * spread
    way = g.normal(size=(500, d))
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    x = centre + way * radius * g.choice([1.0, 1.0, 0.5], size=(500, 1))
    gain = np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)
    bound = approach(old, new, centre, radius)
    assert gain.max() <= bound + 1e-9 * (1 + spread + radius)
    assert bound <= np.linalg.norm(new - old) + 1e-12


def test_bounds_loosen_less_than_full_drift():
    old = np.array([[0.0, 0.0], [100.0, 0.0]])
    new = np.array([[0.0, 0.0], [100.0, 10.0]])
    assert loosening(old, new, np.array([5.0, 5.0]))[0] < 3  # across the line of sight, 10 by full drift
    assert loosening(old, np.array([[0.0, 0.0], [110.0, 0.0]]), np.array([5.0, 5.0]))[0] < -8  # away: the bound rises


def test_squares_are_exact_in_both_ranges():
    g = np.random.default_rng(1)
    for top in (50, 1 << 21, 1 << 27):
        v, c = g.integers(-top, top, (40, 64)), g.integers(-top, top, (5, 64))
        assert squares(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]


def test_query_against_brute_force_and_mostly_unscanned(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    want, cents = brute(rows)
    got = op11_clustering(spark, sf).collect()
    assert sorted((False, r.vec_id, r.cluster, r.distance) for r in got) == want
    for r in got:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()
        assert r.inertia == sum(w[3] for w in want) and r.cluster_inertia == sum(w[3] for w in want if w[2] == r.cluster)


def test_clustered_data_is_seldom_scanned_again(spark):
    g = np.random.default_rng(5)
    middles = g.normal(size=(6, 8)) * 20
    rows = [(i, (middles[i % 6] + g.normal(size=8)).tolist()) for i in range(3000)]
    s = Clustering(k=6, d=8, rounds=6)
    out, cents = clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), s)
    same(out, cents, rows, k=6, d=8, rounds=6)
    assert sum(r.scans for r in out.collect()) < 0.6 * 7 * len(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_odd_rows_and_ties(spark, seed):
    g = np.random.default_rng(seed)
    rows = [(i, [float(x) / 64 for x in g.integers(-2, 3, 4)]) for i in range(60)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, [0.5, -0.5, 0.25, 0.0]), (100, None), (101, []), (102, [1.0, None, 1.0, 1.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0] * 5), (106, [20000.5, -3.0, 0.0, 1.0])]
    rows += [(200 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame([(i, v, "z", 9) for i, v in rows], "vec_id long, embedding array<double>, v string, cluster int")
    same(*clustered(df, Clustering(k=7, d=4)), rows, k=7, d=4)


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i), -1.0]) for i in range(3)]
    same(*clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Clustering(d=2)), rows, d=2)
    one, cents = clustered(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), Clustering(d=2))
    assert with_inertia(one, cents).count() == 1
    none, cents = clustered(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert with_inertia(none, cents).collect() == [] and len(cents) == 0


def test_components_too_large_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        clustered(df, Clustering(d=2))
