"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and their first three, four and five bytes, hashed into a fixed number of
buckets. A second-order factorization machine is fitted on a bounded sample of labelled rows: besides a weight
for each term it has a short vector, and the product of two terms' vectors is the weight of their standing
together. First the buckets that are associated with the label alone take part; then those that stand in
pairs which explain what this first machine gets wrong, though each may tell nothing alone. All pairs of
terms are tested, save those that the errors on the rows of either term show to be too weak. Rows are then
scored where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces, releasing
from .shared import written
from .words import PIECE, WordBatch

BITS = 20
PREFIXES = (3, 4, 5)


@dataclass(frozen=True)
class Fit:
    """Fitting parameters. ``max_rows`` bounds the labelled rows that are learnt from; the buckets bound the terms.

    A term takes part if at least two rows have it and the signed root of its likelihood ratio is ``least_g`` or more, or if
    the first machine's errors on the rows that hold it and some other term sum up to more than they would by chance, where
    ``pair_risk`` bounds the chance that any one of all pairs of terms passes without cause (Bernstein's inequality).
    """

    max_rows: int = 12_000
    least_g: float = 3.0
    pair_risk: float = 0.01
    factors: int = 4
    steps: int = 150
    rate: float = 0.1
    l2: float = 5e-5
    seed: int = 7


@dataclass(frozen=True)
class Machine:
    buckets: np.ndarray
    bias: float
    weight: np.ndarray
    vectors: np.ndarray

    def score(self, row: np.ndarray, term: np.ndarray, n_rows: int) -> np.ndarray:
        """Probability of each row from its (row, term) pairs; pairs are distinct."""
        linear = np.bincount(row, self.weight[term], n_rows)
        pairs = np.zeros(n_rows)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[term, f]
            pairs += np.bincount(row, v, n_rows) ** 2 - np.bincount(row, v * v, n_rows)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -30, 30)))


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every word and prefix, with repeats."""
    words = WordBatch(texts)
    shift = np.uint64(64 - BITS)
    found = [words.hashes, *(words.prefixes(n) + np.uint64(n << 32) for n in PREFIXES)]
    return np.tile(words.text, len(found)), np.concatenate([(h >> shift).astype(np.int64) for h in found])


def _distinct(row: np.ndarray, term: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row * n_terms + term)
    return key // n_terms, key % n_terms


def labelled_terms(docs: DataFrame, labels: DataFrame, fit: Fit, doc_id: str, text: str, label: str) -> DataFrame:
    """``y, terms`` of at most ``fit.max_rows`` labelled rows, in an order that ids' hashes fix."""
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna()
    marks = marks.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.max_rows)  # the bound, so the broadcast is small
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(marks), "doc_id").select("y", "text")

    def run(batches):
        for batch in batches:
            for lo, hi, own in pieces(batch.column(1), PIECE):
                row, term = _distinct(*_terms(own), 1 << BITS)
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term, pa.int32()))], ["y", "terms"])

    return rows.mapInArrow(releasing(run), "y int, terms array<int>")


def fit_machine(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Learn from the rows of ``docs`` that ``labels`` marks. Without labelled rows every text scores one half."""
    rows = written(labelled_terms(docs, labels, fit, doc_id, text, label), "labelled-terms")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, fit.factors)))
    share = min(max(positive / n, 0.5 / n), 1 - 0.5 / n)
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    # signed root of the likelihood ratio of a term's own share of label 1 against the overall share
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / F.col("n") / p)).otherwise(0.0)
    ratio = F.sqrt(F.greatest(F.lit(0.0), 2 * (part("k", share) + part("m", 1 - share))))
    told = counts.withColumn("m", F.col("n") - F.col("k")).withColumn("g", ratio).filter("n >= 2")
    alone = np.sort(told.filter(F.col("g") >= fit.least_g).select("term").toArrow()["term"].to_numpy().astype(np.int64))
    machine = _descend_on(alone, *_gathered(rows, alone), share, fit)
    pairs = _telling_pairs(rows, told.filter(F.col("n") < n), machine, fit)
    if not len(np.setdiff1d(pairs, alone)):
        return machine
    both = np.union1d(alone, pairs)
    return _descend_on(both, *_gathered(rows, both), share, fit)


def _gathered(rows: DataFrame, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term) pairs of all rows with terms among ``buckets``, and the rows' labels; bounded by the rows learnt from."""
    held = _only(rows, buckets).toArrow()
    lists = held["terms"].combine_chunks()
    return np.repeat(np.arange(len(held)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), held["y"].to_numpy().astype(float)


def _descend_on(buckets: np.ndarray, row: np.ndarray, term: np.ndarray, y: np.ndarray, share: float, fit: Fit) -> Machine:
    use = np.isin(term, buckets)
    return _descend(buckets, row[use], np.searchsorted(buckets, term[use]), y, share, fit)


def _only(rows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """``rows`` with the terms (their last column) that are among ``buckets``, in an order that the rows themselves fix."""
    spread = rows.sparkSession.sparkContext.broadcast(buckets.astype(np.int32))
    names = rows.columns

    def run(batches):
        wanted = np.zeros(1 << BITS, bool)
        wanted[spread.value] = True
        for batch in batches:
            terms = batch.column(len(names) - 1)
            flat = terms.flatten().to_numpy(zero_copy_only=False)
            keep = wanted[flat]
            offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
            upto = np.concatenate(([0], np.cumsum(keep)))[offsets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat[keep], pa.int32()))], names)

    return rows.mapInArrow(releasing(run), rows.schema)


#: Terms a side of a block of pairs, and rows of a dense matrix.
BLOCK, DEPTH = 1024, 2048


def _with_errors(rows: DataFrame, machine: Machine) -> DataFrame:
    """``e, v, terms``: what each row's label is above the machine's score, and that score's variance."""
    spread = rows.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = spread.value
        place = np.full(1 << BITS, -1, np.int32)
        place[m.buckets] = np.arange(len(m.buckets))
        for batch in batches:
            terms = batch.column(1)
            row = np.repeat(np.arange(len(batch)), np.diff(terms.offsets.to_numpy()))
            at = place[terms.flatten().to_numpy(zero_copy_only=False)]
            p = m.score(row[at >= 0], at[at >= 0], len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy() - p), pa.array(p * (1 - p)), terms], ["e", "v", "terms"])

    return rows.select("y", "terms").mapInArrow(releasing(run), "e double, v double, terms array<int>")


def _telling_pairs(rows: DataFrame, told: DataFrame, machine: Machine, fit: Fit) -> np.ndarray:
    """Terms of ``told`` that stand in a pair on whose rows the machine's errors sum up to more than chance allows.

    A pair with errors E and variance V passes if E^2 >= 2 c (V + |E| / 3), c being the log of twice the number of pairs over
    ``fit.pair_risk``. That needs |E| >= 2 c / 3, and |E| is at most the sum of either term's errors of one sign, so terms with
    smaller sums stand in no such pair. The others are tested against one another in blocks, a task each.
    """
    spark = rows.sparkSession
    m = told.count()
    if m < 2:
        return np.zeros(0, np.int64)
    c = float(np.log(m * (m - 1) / fit.pair_risk))
    wrong = _with_errors(rows, machine)
    sums = wrong.select("e", F.explode("terms").alias("term")).groupBy("term").agg(F.sum(F.greatest("e", F.lit(0.0))).alias("up"), F.sum(F.greatest(-F.col("e"), F.lit(0.0))).alias("down"))
    able = sums.filter(F.greatest("up", "down") >= 2 * c / 3).join(told.select("term"), "term", "left_semi")
    able = np.sort(able.select("term").toArrow()["term"].to_numpy().astype(np.int64))
    if len(able) < 2:
        return np.zeros(0, np.int64)
    held = _only(wrong, able).toArrow()  # bounded by the rows learnt from
    lists = held["terms"].combine_chunks()
    row = np.repeat(np.arange(len(held), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    term = np.searchsorted(able, lists.flatten().to_numpy()).astype(np.int32)
    order = np.argsort(term, kind="stable")
    blocks = -(-len(able) // BLOCK)
    starts = np.searchsorted(term[order], np.arange(blocks + 1) * BLOCK)
    spread = spark.sparkContext.broadcast((row[order], term[order], starts, held["e"].to_numpy(), held["v"].to_numpy()))

    def run(batches):
        row, term, starts, e, v = spread.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                a, b = divmod(k, blocks)
                if a > b:
                    continue
                sides = [(row[starts[i] : starts[i + 1]], term[starts[i] : starts[i + 1]] - i * BLOCK) for i in (a, b)]
                errors, variance = np.zeros((BLOCK, BLOCK), np.float32), np.zeros((BLOCK, BLOCK), np.float32)
                for lo in range(0, len(e), DEPTH):
                    x = [np.zeros((DEPTH, BLOCK), np.float32) for _ in sides]
                    for dense, (r, t) in zip(x, sides, strict=True):
                        own = (r >= lo) & (r < lo + DEPTH)
                        dense[r[own] - lo, t[own]] = 1
                    n = min(DEPTH, len(e) - lo)
                    errors += x[0][:n].T @ (x[1][:n] * e[lo : lo + n, None].astype(np.float32))
                    variance += x[0][:n].T @ (x[1][:n] * v[lo : lo + n, None].astype(np.float32))
                telling = (errors != 0) & (errors**2 >= 2 * c * (variance + np.abs(errors) / 3))
                if a == b:
                    np.fill_diagonal(telling, False)
                found = np.union1d(np.flatnonzero(telling.any(axis=1)) + a * BLOCK, np.flatnonzero(telling.any(axis=0)) + b * BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["at"])

    found = spark.range(blocks * blocks, numPartitions=min(blocks * blocks, 1024)).mapInArrow(releasing(run), "at long").distinct()
    return able[np.sort(found.toArrow()["at"].to_numpy())]


def _descend(buckets: np.ndarray, row: np.ndarray, term: np.ndarray, y: np.ndarray, share: float, fit: Fit) -> Machine:
    """Full-batch Adam on the logistic loss; the rows' order doesn't matter."""
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    n, d, k = len(y), len(buckets), fit.factors
    bias = np.array([np.log(share / (1 - share))])
    params = [bias, np.zeros(d), np.random.default_rng(fit.seed).normal(0, 0.05, (d, k))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, fit.steps + 1):
        b, w, v = params
        sums = np.stack([np.bincount(row, v[term, f], n) for f in range(k)], 1)
        squares = np.bincount(row, (v * v).sum(1)[term], n)
        z = b[0] + np.bincount(row, w[term], n) + ((sums**2).sum(1) - squares) / 2
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        at = error[row]
        total = np.bincount(term, at, d)
        grad = [np.array([error.sum()]), total + fit.l2 * w, np.stack([np.bincount(term, at * sums[row, f], d) for f in range(k)], 1) - v * total[:, None] + fit.l2 * v]
        for i, g in enumerate(grad):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - fit.rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(buckets, float(params[0][0]), params[1], params[2])


def scored(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score`` of every row, after the columns that ``keep`` names.

    Null texts are empty and score what a text without known terms does; repeated rows and null ids stay;
    an empty table gives an empty one; columns not named aren't read.
    """
    spread = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the buckets
    rows = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
    kept = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *([] if "doc_id" in keep else ["doc_id long"]), "score double"])

    def run(batches):
        m = spread.value
        place = np.full(1 << BITS, -1, np.int16 if len(m.buckets) < 32768 else np.int32)
        place[m.buckets] = np.arange(len(m.buckets))
        for batch in batches:
            for lo, hi, own in pieces(batch.column(len(kept) + 1), PIECE):
                row, bucket = _terms(own)
                term = place[bucket]
                known = term >= 0
                row, term = _distinct(row[known], term[known].astype(np.int64), max(1, len(m.buckets)))
                score = m.score(row, term, hi - lo)
                cut = batch.slice(lo, hi - lo)
                columns = [*cut.columns[: len(kept)], *([] if "doc_id" in keep else [cut.column(len(kept))]), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *([] if "doc_id" in keep else ["doc_id"]), "score"])

    return rows.mapInArrow(releasing(run), schema)


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id's text modulo 5: 0 marks rows that aren't learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def toxicity(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; rows whose id has remainder 0 are never learnt from."""
    machine = fit_machine(docs, labels.filter(remainder(doc_id) != 0), fit, doc_id, text, label)
    out = scored(docs, machine, doc_id, text)
    held = F.coalesce(remainder("doc_id") == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
