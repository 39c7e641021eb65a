import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sysloom.llm.queries import op8_toxicity
from sysloom.llm.toxicity import Fit, Machine, _telling_pairs, _terms, fit_machine, remainder, scored, toxicity
from sysloom.llm.words import WordBatch


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())


def test_words_and_shingles_against_brute_force():
    texts = ["The cat's hat", "", "éa b", "b", "x y z w v u x y z w v", "...", "end"]
    got = WordBatch(pa.array(texts, pa.large_string()))
    spelled = [got.bytes[a:b].tobytes().decode() for a, b in zip(got.starts, got.ends, strict=True)]
    assert spelled == [w for t in texts for w in words(t)]
    assert got.counts.tolist() == [len(words(t)) for t in texts]
    same = {}
    for w, h in zip(spelled, got.hashes.tolist(), strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)
    hashes, owner = got.shingles(5)
    want = [(i, tuple(w[k : k + 5])) for i, w in enumerate(map(words, texts)) for k in range(max(min(len(w), 1), len(w) - 4))]
    assert owner.tolist() == [i for i, _ in want]
    same = {}
    for (_, s), h in zip(want, hashes.tolist(), strict=True):
        assert same.setdefault(s, h) == h
    assert len(set(same.values())) == len(same)


def test_score_is_the_pairwise_sum():
    r = np.random.default_rng(0)
    m = Machine(np.arange(6), 0.3, r.normal(size=6), r.normal(size=(6, 3)))
    rows = [[0, 2, 5], [], [1], [3, 4]]
    got = m.score(np.repeat(np.arange(4), [len(x) for x in rows]), np.concatenate(rows).astype(int), 4)
    for x, p in zip(rows, got, strict=True):
        z = 0.3 + sum(m.weight[i] for i in x) + sum(m.vectors[i] @ m.vectors[j] for k, i in enumerate(x) for j in x[k + 1 :])
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-12


def test_learns_pairs_that_no_sum_of_weights_can(spark):
    """Label 1 only where an insult meets a group, each common alone."""
    r = np.random.default_rng(3)
    rows = []
    for i in range(600):
        a, b = r.random(2) < 0.5
        rows.append((i, f"{'insult ' * int(a)}{'group ' * int(b)}plain words", int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = fit_machine(docs.drop("toxic"), docs.drop("text"))
    got = {x.doc_id: x.score for x in scored(docs, m).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)


def test_learns_terms_that_tell_nothing_alone(spark):
    """Label 1 where exactly one of two words stands: each alone says nothing, with and without other words about."""
    r = np.random.default_rng(5)
    for noise in (0, 40):
        rows = []
        for i in range(800):
            a, b = (i & 1), (i >> 1 & 1)
            other = " ".join(f"w{x}" for x in r.choice(300, noise, replace=False))
            rows.append((i, f"{'insult ' * a}{'group ' * b}plain {other}", a ^ b))
        docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        m = fit_machine(docs.drop("toxic"), docs.drop("text"))
        got = {x.doc_id: x.score for x in scored(docs, m).collect()}
        assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows]) > 0.98


def test_learns_rare_pairs_among_many_frequent_terms(spark):
    """The two words stand in a tenth of the rows each, and some 2,400 other terms are more frequent than they."""
    r, rows = np.random.default_rng(8), []
    for i in range(1500):
        a, b = r.random(2) < 0.1
        other = " ".join(f"{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}{x:04d}" for x in np.flatnonzero(r.random(700) < 0.3))
        rows.append((i, f"{'insult ' * int(a)}{'group ' * int(b)}{other}", int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    m = fit_machine(docs.drop("toxic"), docs.drop("text"))
    got = {x.doc_id: x.score for x in scored(docs, m).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows]) > 0.98


def test_pairs_against_all_pairs_one_by_one(spark, monkeypatch):
    """Which terms stand in a telling pair, by a loop over all pairs, with blocks of a few terms and rows."""
    monkeypatch.setattr("sysloom.llm.toxicity.BLOCK", 8)
    monkeypatch.setattr("sysloom.llm.toxicity.DEPTH", 100)
    r, lists, y = np.random.default_rng(9), [], []
    for i in range(900):
        own = set(np.flatnonzero(r.random(60) < 0.3).tolist())
        lists.append(sorted(own))
        y.append(int((3 in own) != (41 in own)) if r.random() < 0.8 else int(r.random() < 0.5))
    rows = spark.createDataFrame(list(zip(y, lists, strict=True)), "y int, terms array<int>").repartition(3)
    told = spark.createDataFrame([(t,) for t in range(60)], "term int")
    m = Machine(np.array([5]), 0.1, np.array([0.2]), np.zeros((1, 2)))
    got = _telling_pairs(rows, told, m, Fit()).tolist()
    p = 1 / (1 + np.exp(-(0.1 + 0.2 * np.array([5 in x for x in lists]))))
    e, v, c, want = np.array(y) - p, p * (1 - p), np.log(60 * 59 / 0.01), set()
    for i in range(60):
        for j in range(i):
            both = np.array([i in x and j in x for x in lists])
            if e[both].sum() ** 2 >= 2 * c * (v[both].sum() + abs(e[both].sum()) / 3):
                want |= {i, j}
    assert got == sorted(want) and {3, 41} <= want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (None, "", 9), (2, "idiot " * 9000, 9), (2, "idiot " * 9000, 9)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity(docs, none).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    some = spark.createDataFrame([(2, 1), (2, None), (7, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity(docs, some).count() == 4 and toxicity(docs.limit(0), some).collect() == []


def test_query_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op8_toxicity(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    marks = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([g.predicted == y for g, y in marks]) > 0.93
    assert not any(g.predicted for g, y in marks if not y)


def test_query_against_brute_force(spark, sf):
    """Every row's score by adding up weights and products of pairs one by one, with a machine that never saw held-out labels."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.filter(remainder() != 0)
    m = fit_machine(docs, seen)
    place = {int(b): i for i, b in enumerate(m.buckets)}
    got = {r.doc_id: r for r in op8_toxicity(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        _, bucket = _terms(pa.array([r.text or ""], pa.large_string()))
        terms = sorted({place[b] for b in bucket.tolist() if b in place})
        z = m.bias + sum(m.weight[i] for i in terms)
        for k, i in enumerate(terms):
            z += float(m.vectors[i] @ m.vectors[terms[k + 1 :]].sum(axis=0)) if k + 1 < len(terms) else 0.0
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
    flipped = labels.withColumn("toxic", F.when(remainder() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity(docs, flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-12 for i, r in got.items())
