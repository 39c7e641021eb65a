import numpy as np
import pyarrow as pa
import pytest

from sysloom.llm.neighbours import Forest, Search, _best, nearest
from sysloom.llm.queries import op4_neighbours

NAN, INF = float("nan"), float("inf")


def brute(rows, picks, k=5):
    """Exact search over all rows: {query: [(id, score)]}."""
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in sorted(sound, key=lambda r: r[1].tolist(), reverse=True):
        if picks(i):
            best = {}
            for j, v in sound:
                if j != i:
                    s = (v * q).sum() / (np.linalg.norm(v) * np.linalg.norm(q))
                    best[j] = max(best.get(j, -2), s)
            out[i] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, size):
    folder = f"/root/testdata/{size}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, got = brute(rows, lambda i: i % 50 == 0), found(op4_neighbours(spark, folder))
    assert got.keys() == want.keys() and all(len(got[q]) == 5 for q in got)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9
    table = {i: np.array(v, float) for i, v in rows}
    for q, hits in got.items():
        for i, s in hits:
            assert abs(s - table[i] @ table[q] / np.linalg.norm(table[i]) / np.linalg.norm(table[q])) < 1e-12


def test_odd_rows_and_ties(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=4).tolist()) for i in range(40)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(3000)] + [(0, rows[0][1]), (None, [1.0] * 4), (50, None), (200000, [0.0] * 4), (200050, [NAN, 1.0, 1.0, 1.0]), (200100, [INF, 1.0, 1.0, 1.0]), (200150, [1.0, None, 1.0, 1.0]), (200200, [1.0])]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<double>, score double").repartition(4)
    got = found(nearest(df, "vec_id % 50 = 0", search=Search(recall=1.0)))
    want = brute([x for x in rows if x[1] is None or len(x[1]) == 4], lambda i: i % 50 == 0)
    assert got.keys() == want.keys()
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert nearest(df.limit(0), "vec_id % 50 = 0").collect() == []
    assert found(nearest(df.filter("vec_id in (1, 0, 2)"), "vec_id = 0")).keys() == {0}


def test_repeated_rows_take_no_places(spark):
    """Copies of rows, and ids with more rows than places, leave the other ids their places."""
    r = np.random.default_rng(1)
    base = [(i, r.normal(size=4).tolist()) for i in range(400)]
    near = {i: np.array(v) for i, v in base}
    many = [(1000 + i, (near[i] + 0.001 * r.normal(size=4)).tolist()) for i in range(0, 400, 50) for _ in range(20)]
    common = [(7777, r.normal(size=4).tolist()) for _ in range(300)]
    for rows in (base * 2, base * 7, base + many + common):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
        got = found(nearest(df, "vec_id % 50 = 0", search=Search(recall=1.0, leaf_rows=128, block=128)))
        want = brute(rows, lambda i: i % 50 == 0)
        assert got.keys() == want.keys() and all(len(got[q]) == 5 for q in got)
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.95


def test_best_counts_ids():
    x = np.array([[1, 0.001 * j] for j in range(6)] + [[1, 0.1], [1, 0.2], [1, 0.3]])
    ids = pa.array([[1]] * 5 + [[1, 9]] + [[2], [3], [4]], pa.list_(pa.int64()))
    _, row, got, score = _best(ids, x, np.array([[1.0, 0.0]]), 4)
    assert got.tolist() == [1, 9, 2, 3] and row.tolist() == [0, 5, 6, 7] and score[0] == 1


@pytest.mark.parametrize("common", [19_940, 900])
def test_every_query_gets_its_places_on_skewed_tables(spark, common):
    """Most rows equal, or close to one another, with a few far from them and from each other; leaves of all sizes."""
    r = np.random.default_rng(6)
    for spread in (0.0, 1e-6):
        centre = r.normal(size=8)
        rows = [(i, (centre + spread * r.normal(size=8)).tolist()) for i in range(common)] + [(20_000 + 50 * i, r.normal(size=8).tolist()) for i in range(60)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
        got = found(nearest(df, "vec_id % 50 = 0", search=Search(leaf_rows=64, block=64)))
        assert len(got) == -(-common // 50) + 60 and all(len(hits) == 5 for hits in got.values())
        few = {20_000 + 50 * i for i in range(60)}
        want = brute(rows, lambda i: i in few)
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= (0.9 if spread == 0 else 0.5)


def test_deep_trees_are_balanced():
    """Levels below the sample's reach still split their nodes in about halves."""
    r = np.random.default_rng(7)
    x = r.normal(size=(40_000, 16))
    forest = Forest(x[:512], len(x), Search(leaf_rows=16))
    assert forest.depth == 11 and forest.own == 5
    for t in range(2):
        size = np.bincount(forest.leaves(x)[:, t], minlength=1 << forest.depth)
        assert size.max() < 40_000 / (1 << forest.depth) * 12 and (size > 0).mean() > 0.9
    along = forest._along(x[:1])[0]
    seen = list(forest.order(along))
    assert len(seen) == len(set(seen)) == 4 << forest.depth
    assert {(t, int(forest.leaves(x[:1])[0, t])) for t in range(4)} == set(seen[:4])
