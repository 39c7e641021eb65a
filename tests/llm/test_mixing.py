import math
import re
from collections import defaultdict

import pytest

from sysloom.llm import mixing
from sysloom.llm.mixing import Mix, fit, mixed, rated, rates, tokens
from sysloom.llm.queries import domains, op7_mixing, op7_totals


def parts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), domains(spark, sf)


def brute_rates(cells, target, present, min_rate, rounds=5000):
    """Projected gradient with a rate of its own for every document, until it stands still."""
    rate = [1.0] * len(cells)
    for _ in range(rounds):
        total = [sum(r * n * p[d] for r, (n, p) in zip(rate, cells, strict=True)) for d in range(len(target))]
        step = [(e - t) / max(w, 1.0) for e, t, w in zip(total, target, present, strict=True)]
        rate = [max(min_rate, r - 0.5 * sum(a * b for a, b in zip(p, step, strict=True))) for r, (_, p) in zip(rate, cells, strict=True)]
    return rate


def test_targets_are_met(spark, sf):
    docs, labelled = parts(spark, sf)
    for targets, mix in ((None, Mix()), ({"en/1": 0.5, "de/1": 0.25, "fr/1": 0.25}, Mix(min_rate=0.0))):
        f = fit(docs, labelled, targets, mix)
        rows = rated(docs, f, mix).withColumn("n", tokens(docs.text)).select("n", "__post", "__rate").collect()
        names = f.classifier.domains
        got = [sum(r.n * r["__rate"] * r["__post"][d] for r in rows) for d in range(len(names))]
        want = [f.target[d] for d in names]
        cells = [(r.n, r["__post"]) for r in rows]
        exact = brute_rates(cells, want, [f.present[d] for d in names], mix.min_rate, 400)
        best = [sum(x * n * p[d] for x, (n, p) in zip(exact, cells, strict=True)) for d in range(len(names))]
        error = lambda e: sum(abs(a - b) for a, b in zip(e, want, strict=True)) / sum(want)
        assert error(got) <= error(best) + 0.02, (error(got), error(best))
        assert all(r["__rate"] >= mix.min_rate for r in rows)


def test_posteriors_are_exact(spark, sf):
    """Probabilities sum to 1, none is lost to rounding, and the totals are those of the unrounded table."""
    docs, labelled = parts(spark, sf)
    f = fit(docs, labelled)
    c = f.classifier
    rows = mixing.with_features(rated(docs, f), "text", c.words).withColumn("n", tokens(docs.text)).collect()
    present, reached = [0.0] * len(c.domains), [0.0] * len(c.domains)
    for r in rows:
        logs = [c.prior[d] + sum(c.table[k][sum(r[f"__f_{k}"] > x for x in c.cuts[k])][d] for k in c.names) for d in range(len(c.domains))]
        w = [math.exp(z - max(logs)) for z in logs]
        p = [x / sum(w) for x in w]
        assert abs(sum(r["__post"]) - 1) < 1e-9 and all(abs(a - b) < 1e-9 for a, b in zip(p, r["__post"], strict=True))
        for d, x in enumerate(p):
            present[d] += r.n * x
            reached[d] += r.n * r["__rate"] * x
    assert any(0 < x < 1 / 64 for r in rows for x in r["__post"])
    for d, name in enumerate(c.domains):
        assert abs(f.present[name] - present[d]) < 1e-6 * sum(present) and abs(f.reached[name] - reached[d]) < 0.01 * sum(reached)


def test_query_reaches_its_targets(spark, sf):
    """The query's rates may be under 1, and what it reaches are its targets, not only the nearest totals over a bound."""
    got = op7_totals(spark, sf).collect()
    assert all(r.met and abs(r.reached - r.target) <= 0.002 * max(r.target, 1) for r in got), got
    assert abs(sum(r.target for r in got) - sum(r.present for r in got)) < 1e-6 * sum(r.present for r in got)
    assert min(r.rate for r in op7_mixing(spark, sf).collect()) < 1


def test_copies_follow_rates(spark, sf):
    docs, labelled = parts(spark, sf)
    each = {r.doc_id: r for r in rates(docs, labelled).collect()}
    n = defaultdict(int)
    for r in mixed(docs, labelled).collect():
        n[r.doc_id] += 1
    assert n == {i: r.copies for i, r in each.items()} and all(r.rate - 1 < r.copies < r.rate + 1 and r.copies >= 1 for r in each.values())


def test_classifier_knows_languages(spark):
    docs, labelled = parts(spark, "/root/testdata/sf0.01")
    lang = {r.doc_id: r.lang for r in docs.collect() if len(r.text) > 300}
    got = {r.doc_id: r.domain[:2] for r in rates(docs, labelled).collect() if r.doc_id in lang}
    assert sum(got[i] == lang[i] for i in lang) / len(lang) > 0.95


def test_classifier_knows_topics_by_their_words(spark):
    """Domains of one language and form, which only words tell apart; targets move the totals, and words are found as by counting."""
    import random

    g = random.Random(4)
    topics = {"cooking": "oven flour butter simmer whisk dough".split(), "sailing": "mast keel rudder tack harbour knot".split(), "law": "tort plaintiff statute appeal verdict clause".split()}
    common = "the of and to in is that for it with as was on be at by this had not are but from or have an they which one you were all".split()
    rows = []
    for i in range(600):
        d = list(topics)[i % 3]
        rows.append((i, " ".join(g.choice(topics[d]) if g.random() < 0.06 else g.choice(common) for _ in range(120)), d))
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    labelled = docs.filter("doc_id < 300").select("doc_id", "domain")
    told = mixing.telling(docs, mixing.marked(labelled, "doc_id", "domain"), Mix(words=6), "doc_id", "text")
    assert all(set(words) == set(topics[d]) for d, words in told.items())
    got = {r.doc_id: r for r in rates(docs, labelled, {"cooking": 0.6, "sailing": 0.2, "law": 0.2}, Mix(min_rate=0.0)).collect()}
    assert sum(got[i].domain == d for i, _, d in rows if i >= 300) > 285
    mean = {d: sum(got[i].rate for i, _, x in rows if x == d) / 200 for d in topics}
    assert mean["cooking"] > 1.5 and mean["law"] < 0.8 and mean["sailing"] < 0.8


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (None, "the of and " * 5000, 3.0), (2, "", 3.0)], "doc_id long, text string, rate double")
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = rates(docs, none).collect()
    assert len(got) == 4 and {(r.domain, r.rate, r.copies) for r in got} == {("all", 1.0, 1)}
    some = spark.createDataFrame([(1, "a"), (2, "b"), (2, None), (None, "c"), (9, "d")], "doc_id long, domain string")
    assert rates(docs, some).count() == 4 and rates(docs.limit(0), some).collect() == []
    assert mixed(docs, some).columns == docs.columns and mixed(docs.limit(0), some).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = op7_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and mixing.NAMES


def test_targets_out_of_reach_have_an_answer(spark):
    """Where documents can't meet the targets, rates are those of plain projected gradient; a fit cut short gives its best point."""
    cells = [(float(5 + i % 7), [0.5 + 0.3 * ((i * 7 % 10) / 10), 0.3 - 0.2 * ((i * 7 % 10) / 10), 0.2 - 0.1 * ((i * 7 % 10) / 10)]) for i in range(200)]
    rows = spark.createDataFrame(cells, "n double, post array<double>").cache()
    present = [sum(n * p[d] for n, p in cells) for d in range(3)]
    weight, whole = [0.05, 0.05, 0.9], sum(present)
    s, total, reached, met = mixing._solve(rows, present, weight, whole, Mix(min_rate=0.0))
    exact = brute_rates(cells, [w * whole for w in weight], present, 0.0, 4000)
    best = [sum(r * n * p[d] for r, (n, p) in zip(exact, cells, strict=True)) for d in range(3)]
    miss = lambda e: sum((a - w * whole) ** 2 / b for a, w, b in zip(e, weight, present, strict=True))
    assert not met and miss(reached) <= miss(best) * 1.001
    short = mixing._solve(rows, present, weight, whole, Mix(min_rate=0.0, rounds=2))
    assert not short[3] and miss(reached) <= miss(short[2]) <= miss(present)


def test_every_domain_counts(spark):
    """No domain is cut off, a target for an unknown one is an error, and any white space parts tokens."""
    docs = spark.createDataFrame([(i, f"word{i} " * (i + 1)) for i in range(66)], "doc_id long, text string")
    labelled = docs.selectExpr("doc_id", "concat('d', doc_id) AS domain")
    rows, words = mixing.measured(docs, labelled, Mix(), "doc_id", "text", "domain")
    c = mixing.fit_classifier(rows, words, labelled, Mix(), "doc_id", "domain")
    assert len(c.domains) == 66 and all(len(x) == 66 for t in c.table.values() for x in t)
    with pytest.raises(ValueError, match="elsewhere"):
        fit(docs, docs.selectExpr("doc_id", "'a' AS domain"), {"a": 0.5, "elsewhere": 0.5})
    rows = spark.createDataFrame([("a\nb\tc  d\u00a0e\u3000f",), (" \n",), ("",), (None,)], "text string")
    assert [r.n for r in rows.select(tokens(rows.text).alias("n")).collect()] == [6, 0, 0, 0]
