"""Approximate nearest neighbours with a forest of random-projection trees.

Every level of every tree has a random direction and splits each node at the median of a bounded sample
along it. A query walks all trees through one priority queue: nodes come out by the squared distances
to the splits on whose far side they lie, until a number of leaves is reached and these leaves are known to
hold enough candidates. Rows and queries then meet leaf by leaf, and the candidates of a leaf are ranked
exactly. How many leaves to visit is measured: for a bounded sample of queries the true neighbours are found
by comparing with all rows in blocks, and the number is the one that reaches the wanted share of them.

Equal vectors are one point that carries its smallest ids, as many as any query can want, so however many
rows share a vector they cost one comparison.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, written


@dataclass(frozen=True)
class Search:
    """``sample`` points at most shape the trees and ``trials`` queries at most set the number of leaves; every row is indexed.

    ``recall`` is the share of the trial queries' true neighbours that the visited leaves must hold. Trees are deep enough
    for leaves of about ``leaf_rows`` points at any size of the table; blocks of a leaf have about ``block``.
    Nodes with fewer than ``least`` points of the sample split where the last node above them with as many does.
    """

    trees: int = 4
    leaf_rows: int = 1024
    sample: int = 16_384
    least: int = 16
    trials: int = 64
    recall: float = 0.97
    block: int = 2048
    seed: int = 3


class Forest:
    def __init__(self, sample: np.ndarray, n_points: int, s: Search):
        self.depth = max(1, int(np.round(np.log2(max(2, n_points / s.leaf_rows)))))
        #: Levels whose nodes have splits of their own; deeper ones share those of their node at this level.
        self.own = min(self.depth, max(0, int(np.log2(max(1, len(sample) / s.least)))))
        g, d = np.random.default_rng(s.seed), sample.shape[1]
        directions = g.normal(size=(d, s.trees * self.depth))
        self.directions = (directions / np.linalg.norm(directions, axis=0)).reshape(d, s.trees, self.depth)
        self.splits: list[list[np.ndarray]] = []
        along = self._along(sample)
        for t in range(s.trees):
            node, levels = np.zeros(len(sample), int), []
            for level in range(self.depth):
                p, size = along[:, t, level], 1 << min(level, self.own)
                order = np.argsort(node, kind="stable")
                at = np.searchsorted(node[order], np.arange(size + 1))
                split = np.array([np.median(p[order[a:b]]) if b > a else 0.0 for a, b in zip(at[:-1], at[1:], strict=True)])
                levels.append(split)
                if level < self.own:
                    node = 2 * node + (p > split[node])
            self.splits.append(levels)
        self.counts = np.zeros((s.trees, 1 << self.depth), np.int64)  # ids of which the leaf holds the first point
        self.blocks = np.ones_like(self.counts)  # blocks that a leaf's points are dealt to
        self.parts = np.ones_like(self.counts)  # parts that a leaf's queries are dealt to

    def _along(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.einsum("nd,dtl->ntl", unit, self.directions, optimize=True)

    def _split(self, t: int, level: int, node):
        return self.splits[t][level][node >> max(0, level - self.own)]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        along = self._along(x)
        out = np.zeros(along.shape[:2], np.int64)
        for t in range(len(self.splits)):
            for level in range(self.depth):
                out[:, t] = 2 * out[:, t] + (along[:, t, level] > self._split(t, level, out[:, t]))
        return out

    def order(self, along: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order in which one priority queue over all trees yields them."""
        queue = [(0.0, t, 0, 0) for t in range(len(self.splits))]
        while queue:
            cost, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                margin = along[t, level] - self._split(t, level, node)
                heapq.heappush(queue, (cost + margin * margin, t, level + 1, 2 * node + int(margin <= 0)))
                node, level = 2 * node + int(margin > 0), level + 1
            yield t, node

    def visit(self, along: np.ndarray, n_leaves: int, k: int) -> Iterator[tuple[int, int]]:
        """At least ``n_leaves`` leaves, and as many more as it takes until those of one tree hold ``k`` ids for certain."""
        held = [0] * len(self.splits)
        for n, (t, leaf) in enumerate(self.order(along), 1):
            yield t, leaf
            held[t] += int(self.counts[t, leaf])
            if n >= n_leaves and max(held) >= k:
                return


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _best(lists: pa.Array, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, id, score) of each query's ``k`` best ids, by the best row of each; a row has a list of ids.

    A product of matrices screens; scores are then sums in a fixed order, so equal vectors have equal scores.
    """
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
    xn, qn = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    out = []
    by_id = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.r_[True, ids[by_id][1:] != ids[by_id][:-1]]) if len(ids) else by_id
    single = len(starts) == len(ids) == len(x)
    for lo in range(0, len(q), 256):
        rough = (q[lo : lo + 256] @ x.T) / qn[lo : lo + 256, None] / xn
        each = rough if single else np.maximum.reduceat(rough[:, row[by_id]], starts, axis=1)
        bound = np.partition(each, -k, axis=1)[:, -k] if len(starts) > k else np.full(len(rough), -2.0)
        for i, (own, least) in enumerate(zip(rough, bound, strict=True)):
            near = own >= least - 1e-9
            at = np.flatnonzero(near if single else near[row])
            r = row[at]
            score = (x[r] * q[lo + i]).sum(axis=1) / (xn[r] * qn[lo + i])
            order = np.lexsort((ids[at], -score))
            order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])][:k]
            out.append((np.full(len(order), lo + i), r[order], ids[at][order], score[order]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _key(v: str) -> list:
    """Two hashes that name a vector."""
    return [F.xxhash64(v).alias("h1"), F.xxhash64(v, F.lit(1)).alias("h2")]


KEY = "h1 long, h2 long"


def nearest(vectors: DataFrame, queries, k: int = 5, search: Search = Search(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest cosine found for every row that ``queries`` (a condition on ``vec_id``) picks.

    A query's own id is no candidate; ties go to the smaller id. Rows without an id and vectors that are null,
    zero, hold null or non-finite components or don't have the commonest length take no part. Of rows that
    repeat an id the best counts as a candidate, and the smallest vector is the query. Every query gets ``k`` rows if so many
    other ids exist. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    source = source.filter(sound)
    common = source.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not common or not common.d:
        return empty
    d = common.d
    source = source.filter(F.size("v") == d)
    asked = written(source.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), *_key("v"), "v"), "asked")
    if asked.isEmpty():
        return empty
    # a point for every distinct vector, with the k + 1 smallest of its ids: tasks cut longer lists before the shuffle
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = source.dropDuplicates(["vec_id", "v"]).withColumn("place", place).filter(F.col("place") <= k + 1)
    points = written(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(*_key("v"), "v", "ids"), "points")
    n_points = points.count()
    sample = points.orderBy("h1", "h2", "v").limit(search.sample).select("v").toArrow()["v"].combine_chunks()
    forest = Forest(_matrix(sample, d), n_points, search)
    _count_leaves(points, forest, d, search)
    n_leaves = _leaves_needed(points, asked, forest, k, d, search)
    spread = spark.sparkContext.broadcast(forest)  # counts of its leaves, one for every leaf_rows points, and bounded splits

    def walk(batches):
        f = spread.value
        for batch in batches:
            along = f._along(_matrix(batch.column(2), d))
            for lo in range(0, batch.num_rows, 256):
                own = batch.slice(lo, 256)
                visits = [[t << f.depth | leaf for t, leaf in f.visit(along[lo + i], n_leaves, k + 1)] for i in range(own.num_rows)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(visits, pa.list_(pa.int64()))], ["h1", "h2", "v", "leaves"])

    distinct = asked.dropDuplicates(["h1", "h2"]).select("h1", "h2", "v")
    walks = written(distinct.mapInArrow(walk, f"{KEY}, v array<double>, leaves array<long>"), "walks")
    for r in walks.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * search.block).toLocalIterator():
        forest.parts[r.leaf >> forest.depth, r.leaf & ((1 << forest.depth) - 1)] = -(-r.n // (2 * search.block))
    dealt = spark.sparkContext.broadcast(forest)

    schema = f"leaf long, salt long, part long, {KEY}, v array<double>, ids array<long>"
    names = ["leaf", "salt", "part", "h1", "h2", "v", "ids"]

    def deal_points(batches):
        f = dealt.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                own = batch.slice(lo, 4096)
                mark, leaf = own.column(0).to_numpy(zero_copy_only=False), f.leaves(_matrix(own.column(2), d))
                for t in range(leaf.shape[1]):
                    at = leaf[:, t]
                    salt, n = (mark >> 7) % f.blocks[t, at], f.parts[t, at]
                    row = np.repeat(np.arange(len(at)), n)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    some = own.take(pa.array(row)) if len(row) > len(at) else own
                    yield pa.RecordBatch.from_arrays([pa.array(t << f.depth | at[row]), pa.array(salt[row]), pa.array(part), *some.columns], names)

    def deal_queries(batches):
        f = dealt.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                own = batch.slice(lo, 64)
                lists = own.column(3)
                row, leaf = np.repeat(np.arange(own.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
                t, at = leaf >> f.depth, leaf & ((1 << f.depth) - 1)
                part = (own.column(1).to_numpy(zero_copy_only=False)[row] >> 7) % f.parts[t, at]
                n = f.blocks[t, at]
                again = np.repeat(np.arange(len(row)), n)
                salt = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                some = own.take(pa.array(row[again]))
                none = pa.array([None] * len(again), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[again]), pa.array(salt), pa.array(part[again]), *some.columns[:3], none], names)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """One row for a query and leaf, with the query's best ids there."""
        i, ids, s = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            i, _, ids, s = _best(left["ids"].combine_chunks(), _matrix(left["v"].combine_chunks(), d), _matrix(right["v"].combine_chunks(), d), k + 1)
        q, n = np.unique(i, return_counts=True)  # _best goes query by query
        ends = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(s, pa.float64()))]
        return pa.table({"h1": right["h1"].take(pa.array(q)), "h2": right["h2"].take(pa.array(q)), "ids": lists[0], "scores": lists[1]})

    group = ["leaf", "salt", "part"]
    found = points.mapInArrow(deal_points, schema).groupBy(*group).cogroup(walks.mapInArrow(deal_queries, schema).groupBy(*group)).applyInArrow(meet, f"{KEY}, ids array<long>, scores array<double>")
    hits = found.select("h1", "h2", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("h")).select("h1", "h2", "h.*")
    best = hits.groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score"))
    top = best.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k + 1)
    # one row for a query's vector, however many queries share it; each leaves out its own id
    lists = top.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("hits"))
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    ranked = asked.select("query_id", "h1", "h2").join(lists, ["h1", "h2"]).select("query_id", F.posexplode(others).alias("at", "h"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "h.vec_id", "h.score")


def _count_leaves(points: DataFrame, forest: Forest, d: int, search: Search) -> None:
    """Points of every leaf, for its blocks, and ids whose first point it holds: these are counted once in a tree."""
    spread = points.sparkSession.sparkContext.broadcast(forest)

    def code(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                own = batch.slice(lo, 4096)
                leaves = spread.value.leaves(_matrix(own.column(1), d))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel()), leaves.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column(0), lists, own.column(2)], ["h1", "leaves", "ids"])

    coded = written(points.select("h1", "v", "ids").mapInArrow(code, "h1 long, leaves array<long>, ids array<long>"), "leaves")
    rows = coded.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    firsts = coded.select("h1", "leaves", F.explode("ids").alias("id")).groupBy("id").agg(F.min(F.struct("h1", "leaves")).alias("p"))
    ids = firsts.select(F.posexplode("p.leaves").alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    for table, into in ((rows, forest.blocks), (ids, forest.counts)):
        got = table.toArrow()
        into[got["tree"].to_numpy(), got["leaf"].to_numpy()] = got["n"].to_numpy()
    forest.blocks[:] = np.maximum(1, -(-forest.blocks // search.block))
    discard(coded)


def _leaves_needed(points: DataFrame, asked: DataFrame, forest: Forest, k: int, d: int, search: Search) -> int:
    """Leaves to visit so that the wanted share of the trial queries' true neighbours is met."""
    trial = asked.orderBy(F.xxhash64("query_id", F.lit(search.seed + 1)), "query_id").limit(search.trials).toArrow()
    ids, q = trial["query_id"].to_numpy(), _matrix(trial["v"].combine_chunks(), d)

    def exact(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                own = batch.slice(lo, 4096)
                i, j, other, s = _best(own.column(1), _matrix(own.column(0), d), q, k + 1)
                real = other != ids[i]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i][real]), pa.array(other[real]), pa.array(s[real]), own.column(0).take(pa.array(j[real]))], ["query_id", "vec_id", "score", "v"])

    every = written(points.select("v", "ids").mapInArrow(exact, "query_id long, vec_id long, score double, v array<double>"), "trial")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = every.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "v")).alias("b")).select("query_id", "vec_id", "b.*")
    truth = best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "v").toArrow()
    discard(every)
    if not truth.num_rows:
        return 1
    leaf = forest.leaves(_matrix(truth["v"].combine_chunks(), d))
    along, wanted = dict(zip(ids.tolist(), forest._along(q), strict=True)), {}
    for i, row in zip(truth["query_id"].to_pylist(), leaf, strict=True):
        wanted.setdefault(i, []).append({(t, int(x)) for t, x in enumerate(row)})
    places = []
    for i, targets in wanted.items():
        for n, at in enumerate(forest.order(along[i]), 1):
            missed = [x for x in targets if at not in x]
            places += [n] * (len(targets) - len(missed))
            targets = missed
            if not targets:
                break
    return int(np.quantile(places, search.recall, method="higher"))
