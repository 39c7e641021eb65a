"""Mixing to target weights with soft membership, in DataFrame functions alone.

A naive Bayes table over binned features, learnt from the rows that a labelled table marks, gives every
document the probabilities of its domains. Features are shares of letters, symbols and digits, lengths, repetition and, for
each domain, the share of a document's distinct words that tell the domain from the others. Projected-gradient least squares then finds a rate of at least
``min_rate`` for every document, so that the expected tokens of each domain (tokens times rate times
probability, summed) match the targets. The gradient has one number per domain, and the rate of a document
follows from its probabilities and the summed gradients; so each round is one aggregate over the distinct
tuples of bins, and no document carries state. The fit ends within the tolerance, at the least squares solution, or at the best point
of a bounded number of rounds; ``totals`` tells which targets are met.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, written


@dataclass(frozen=True)
class Mix:
    """``flatten`` is the power of a domain's present share that its default target share is proportional to.

    Telling words are learnt from at most ``word_rows`` labelled rows: the ``words`` most associated with each domain, of those that
    ``word_least`` rows have. ``pull`` is the weight of rates near 1 against targets met, ``still`` the scaled gradient at which a fit stands still.
    A round is sped up by the last ``memory`` ones.
    """

    bins: int = 8
    words: int = 32
    word_rows: int = 20_000
    word_least: int = 5
    flatten: float = 0.8
    min_rate: float = 1.0
    rounds: int = 200
    tolerance: float = 0.002
    pull: float = 1e-6
    still: float = 1e-6
    memory: int = 24


#: Shares of characters that each pattern counts; letters tell languages apart, symbols and digits tell prose from junk.
SHARES = {"german": "[äöüßÄÖÜ]", "french": "[èêçàœÈÇ]", "spanish": "[ñíóÑÍÓ]", "symbols": r"[|#*=_~^<>{}\[\]\\/]", "digits": "[0-9]"}


def features(text: Column, words: list[list[str]]) -> dict[str, Column]:
    """Numeric features of a text; the empty text has zeros. ``words``: the telling words of each domain."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(body), F.lit(1))
    out = {k: F.regexp_count(body, F.lit(p)) / n for k, p in SHARES.items()}
    split = F.col("__split")
    out["length"] = F.log1p(F.length(body).cast("double"))
    out["word"] = F.length(body) / F.size(split)
    out["fresh"] = F.size("__distinct") / F.size(split)
    for i in range(len(words)):
        out[f"w{i}"] = F.size(F.array_intersect("__told", _texts(words[i]))) / F.size("__distinct")
    return out


def _texts(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def telling(docs: DataFrame, marks: DataFrame, mix: Mix, doc_id: str, text: str) -> dict[str, list[str]]:
    """The words most associated with each domain: by likelihood ratio over at most ``mix.word_rows`` marked rows, whose order ids' hashes fix."""
    marks = marks.orderBy(F.xxhash64("__id"), "__id").limit(mix.word_rows)  # the bound, so the broadcast is small
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("text")).join(F.broadcast(marks), "__id")
    sizes = {r["__domain"]: r.n for r in rows.groupBy("__domain").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {d: [] for d in sizes}
    whole = sum(sizes.values())
    share = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, n / whole)])
    counts = rows.select("__domain", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), " "))).alias("word")).groupBy("word", "__domain").agg(F.count("*").alias("k"))
    counts = written(counts, "word-counts")
    totals = counts.groupBy("word").agg(F.sum("k").alias("n")).filter(F.col("n") >= mix.word_least)
    both = counts.join(totals, "word").withColumn("p", F.element_at(share, F.col("__domain"))).filter((F.col("k") > F.col("n") * F.col("p")) & (F.length("word") > 0))
    rest = F.col("n") - F.col("k")
    ratio = F.col("k") * F.log(F.col("k") / F.col("n") / F.col("p")) + F.when(rest > 0, rest * F.log(rest / F.col("n") / (1 - F.col("p")))).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy("__domain").orderBy(F.desc(F.round(ratio, 9)), "word"))
    best = both.withColumn("place", place).filter(F.col("place") <= mix.words).select("__domain", "word").collect()
    discard(counts)
    return {d: sorted(r.word for r in best if r["__domain"] == d) for d in sizes}


def tokens(text: Column) -> Column:
    """Size of a text that rates are balanced by: its words between white space of any kind."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\s\p{Z}\x85]+")), F.lit(0)).cast("double")


class DomainClassifier:
    """Log-probabilities of bins by domain; ``cuts`` are the bins' upper ends, ``words`` the telling words of each domain."""

    def __init__(self, domains: list[str], prior: list[float], cuts: dict[str, list[float]], table: dict[str, list[list[float]]], words: list[list[str]]):
        self.domains, self.prior, self.cuts, self.table, self.words = domains, prior, cuts, table, words

    @property
    def names(self) -> list[str]:
        return names(self.words)

    def binned(self, values: dict[str, Column]) -> dict[str, Column]:
        out = {}
        for k, v in values.items():
            b = F.lit(0)
            for c in self.cuts[k]:
                b = b + F.when(v > c, 1).otherwise(0)
            out[k] = b
        return out

    def with_posterior(self, rows: DataFrame, bins: dict[str, Column], name: str) -> DataFrame:
        """``rows`` with the probabilities in the order of ``domains``; each step is a column, so nothing is worked out twice."""
        each, logs = range(len(self.domains)), []
        for d in each:
            z = F.lit(self.prior[d])
            for k, b in bins.items():
                z = z + F.get(F.array(*[F.lit(row[d]) for row in self.table[k]]), b)
            logs.append(z)
        rows = rows.withColumn("__logs", F.array(*logs)).withColumn("__top", F.array_max("__logs"))
        rows = rows.withColumn("__weights", F.array(*[F.exp(F.get("__logs", d) - F.col("__top")) for d in each]))
        rows = rows.withColumn("__total", sum((F.get("__weights", d) for d in each), F.lit(0.0)))
        return rows.withColumn(name, F.array(*[F.get("__weights", d) / F.col("__total") for d in each])).drop("__logs", "__top", "__weights", "__total")


def with_features(docs: DataFrame, text: str, words: list[list[str]]) -> DataFrame:
    """``docs`` with a column for each feature; words are split once, and looked up in all telling words at once."""
    every = sorted({w for ws in words for w in ws})
    rows = docs.withColumn("__split", F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), " ")).withColumn("__distinct", F.array_distinct("__split"))
    rows = rows.withColumn("__told", F.array_intersect("__distinct", _texts(every)))
    return rows.withColumns({f"__f_{k}": v for k, v in features(F.col(text), words).items()}).drop("__split", "__distinct", "__told")


NAMES = [*SHARES, "length", "word", "fresh"]


def names(words: list[list[str]]) -> list[str]:
    """Names of all features."""
    return [*NAMES, *(f"w{i}" for i in range(len(words)))]


def marked(labelled: DataFrame, doc_id: str, domain: str) -> DataFrame:
    """The domain of every labelled id (the smallest where it has several)."""
    rows = labelled.select(F.col(doc_id).cast("long").alias("__id"), F.col(domain).cast("string").alias("__domain")).dropna()
    return rows.groupBy("__id").agg(F.min("__domain").alias("__domain"))


def measured(docs: DataFrame, labelled: DataFrame, mix: Mix, doc_id: str, text: str, domain: str) -> tuple[DataFrame, list[list[str]]]:
    """``doc_id``, tokens and features of every row, written once, and the telling words: all that fitting needs of the texts."""
    told = telling(docs, marked(labelled, doc_id, domain), mix, doc_id, text)
    words = [told[d] for d in sorted(told)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = with_features(rows, "text", words).withColumn("__n", tokens(F.col("text")))
    return written(rows.select("doc_id", "__n", *[f"__f_{k}" for k in names(words)]), "features"), words


def fit_classifier(rows: DataFrame, words: list[list[str]], labelled: DataFrame, mix: Mix, doc_id: str, domain: str) -> DomainClassifier:
    """Learn from the measured rows whose id ``labelled`` has.

    Counts by domain, feature and bin are taken over all labelled rows, and all their domains are told apart. Without labelled rows there is one domain, ``all``.
    """
    marks, every = marked(labelled, doc_id, domain), names(words)
    rows = rows.join(marks, rows["doc_id"] == marks["__id"]).select("__domain", *[f"__f_{k}" for k in every])
    rows = written(rows, "labelled-features")
    top = rows.groupBy("__domain").agg(F.count("*").alias("n")).orderBy("__domain").collect()
    if not top:
        return DomainClassifier(["all"], [0.0], {k: [] for k in every}, {k: [[0.0]] for k in every}, words)
    domains = sorted(r["__domain"] for r in top)
    total = sum(r.n for r in top)
    prior = {r["__domain"]: math.log(r.n / total) for r in top}
    points = [i / mix.bins for i in range(1, mix.bins)]
    cuts_row = rows.agg(*[F.percentile_approx(f"__f_{k}", points, 1000).alias(k) for k in every]).first()
    cuts = {k: sorted(set(cuts_row[k])) for k in every}
    classifier = DomainClassifier(domains, [prior[d] for d in domains], cuts, {}, words)
    bins = classifier.binned({k: F.col(f"__f_{k}") for k in every})
    pairs = F.array(*[F.struct(F.lit(k).alias("f"), b.cast("int").alias("b")) for k, b in bins.items()])
    counted = rows.select("__domain", F.explode(pairs).alias("p")).groupBy("__domain", "p.f", "p.b").agg(F.count("*").alias("n")).collect()
    n = {(r["__domain"], r.f, r.b): r.n for r in counted}
    size = {r["__domain"]: r.n for r in top}
    for k in every:
        m = len(cuts[k]) + 1
        classifier.table[k] = [[math.log((n.get((d, k, b), 0) + 0.5) / (size[d] + 0.5 * m)) for d in domains] for b in range(m)]
    return classifier


def _rate(post: Column, summed: list[float], min_rate: float) -> Column:
    """Rate of a document: 1 less its probabilities times the summed gradients, projected to at least ``min_rate``."""
    step = F.lit(0.0)
    for d, g in enumerate(summed):
        step = step + F.get(post, d) * g
    return F.greatest(F.lit(float(min_rate)), 1.0 - step)


@dataclass(frozen=True)
class Fitted:
    classifier: DomainClassifier
    summed: list[float]
    present: dict[str, float]
    target: dict[str, float]
    reached: dict[str, float]
    #: Every total is within the tolerance of its target; else they are as near as ``min_rate`` and the posteriors let them be.
    met: bool


def _sums(cells: DataFrame, exprs: list[Column]) -> list[float]:
    """Sums over all cells, a few hundred expressions a job."""
    out: list[float] = []
    for lo in range(0, len(exprs), 200):
        out += cells.agg(*[F.coalesce(F.sum(e), F.lit(0.0)) for e in exprs[lo : lo + 200]]).first()
    return out


def _direction(slope: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The way that ``slope`` and the last rounds' moves and changes of slope point to (two loops over at most a few dozen rounds)."""
    q, back = slope.copy(), []
    for move, change in reversed(moves):
        a = (move @ q) / (move @ change)
        back.append(a)
        q -= a * change
    if moves:
        move, change = moves[-1]
        q *= (move @ change) / (change @ change)
    for (move, change), a in zip(moves, reversed(back), strict=True):
        q += (a - (change @ q) / (move @ change)) * move
    return -q


def _solve(cells: DataFrame, present: list[float], weight: list[float], whole: float, mix: Mix):
    """Summed gradients, total of the targets, reached totals, and whether all are within the tolerance.

    Projected gradient on the rates, each domain's miss scaled by its present total: a round works out all rates, as 1 less the
    gradients summed so far and not under ``min_rate``, and with them one sum a domain, the next gradient. So scaled, a step of
    one gradient never goes too far. Rounds are sped up by the moves of the last ones, and a step that doesn't lower the
    objective is halved. The objective, the squares of rates less 1 and, 1/``pull`` times as heavy, of the misses over the present
    totals, is smooth and strongly convex in the summed gradients, so a vanishing gradient proves the solution. With a
    ``min_rate`` of 1 or more the total is free, and the fit finds it. After ``rounds`` rounds, or where rounding leaves no lower point, the
    best point found is the result, and what it reaches tells how near it is.
    """
    k, w = len(present), np.array(weight)
    scale = np.maximum(np.array(present), 1.0)
    root = np.sqrt(scale)
    free = mix.min_rate >= 1 and bool(w.any())
    basis = np.linalg.svd((w / root)[None])[2][1:].T if free else np.eye(k)

    def look(y):
        s = basis @ y / root
        rate = F.greatest(F.lit(float(mix.min_rate)), 1.0 - sum((F.get("post", d) * float(g) for d, g in enumerate(s)), F.lit(0.0)))
        rows = cells.select("n", "post", rate.alias("r"))
        got = _sums(rows, [F.col("n") * (F.col("r") - 1) * (F.col("r") - 1) / 2, *[F.col("n") * F.col("r") * F.get("post", d) for d in range(k)]])
        e = np.array(got[1:])
        total = float((w * e / scale).sum() / (w * w / scale).sum()) if free else whole
        t = w * total
        value = -(got[0] + s @ (e - t)) + mix.pull / 2 * y @ y
        slope = basis.T @ ((t - e) / root) + mix.pull * y
        met = bool((np.abs(e - t) <= mix.tolerance * np.maximum(t, max(1e-9 * total, 1.0))).all())
        missed = got[0] + float(((e - t) ** 2 / scale).sum()) / (2 * mix.pull)
        return y, s, e, total, value, slope, met, missed

    now, moves = look(np.zeros(basis.shape[1])), []
    best = now
    for _ in range(mix.rounds):
        y, _, _, _, value, slope, met, _ = now
        if met or np.linalg.norm(slope) <= mix.still * math.sqrt(max(whole, 1.0)):
            break
        step, part = _direction(slope, moves), 1.0
        if step @ slope >= 0:
            step, moves = -slope, []
        while part >= 1e-9:
            tried = look(y + part * step)
            if tried[4] <= value + 1e-4 * part * (step @ slope) + 1e-12 * abs(value):
                break
            part /= 2
        else:
            break
        move, change = tried[0] - y, tried[5] - slope
        if move @ change > 1e-14 * (move @ move):
            moves = [*moves, (move, change)][-mix.memory :]
        now = tried
        if now[7] <= best[7]:
            best = now
    _, s, e, total, _, _, met, _ = now if now[6] else best
    return s.tolist(), total, e.tolist(), met


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", domain: str = "domain") -> Fitted:
    """``fit_measured`` on the texts of ``docs``."""
    rows, words = measured(docs, labelled, mix, doc_id, text, domain)
    return fit_measured(rows, words, labelled, targets, mix, doc_id, domain)


def fit_measured(rows: DataFrame, words: list[list[str]], labelled: DataFrame, targets: dict[str, float] | None, mix: Mix, doc_id: str, domain: str) -> Fitted:
    """Classifier and summed gradients. ``targets``: weight of each domain (others 0; a domain without labelled rows is an error); without it, present shares flattened.

    If ``min_rate`` is 1 or more the total is the one of the fit that changes rates least, else the present total.
    """
    classifier = fit_classifier(rows, words, labelled, mix, doc_id, domain)
    every, told = classifier.domains, classifier.names
    if unknown := sorted(d for d, t in (targets or {}).items() if t > 0 and d not in every):
        raise ValueError(f"targets for domains that no labelled row has: {unknown}")
    rows = rows.withColumns({f"__b_{k}": b for k, b in classifier.binned({k: F.col(f"__f_{k}") for k in told}).items()})
    # the tuple of bins settles the probabilities, so equal tuples are one cell and nothing is rounded
    cells = rows.groupBy(*[f"__b_{k}" for k in told]).agg(F.sum("__n").alias("n"))
    cells = written(classifier.with_posterior(cells, {k: F.col(f"__b_{k}") for k in told}, "post").select("n", "post"), "cells")

    present = _sums(cells, [F.col("n") * F.get("post", d) for d in range(len(every))])
    whole = sum(present)
    if targets is None:
        weight = [(p / whole) ** mix.flatten if p > 0 else 0.0 for p in present]
    else:
        weight = [max(0.0, float(targets.get(d, 0.0))) for d in every]
    scale = sum(weight) or 1.0
    weight = [w / scale for w in weight]
    summed, total, reached, met = _solve(cells, present, weight, whole, mix)
    target = [w * total for w in weight]
    as_dict = lambda x: dict(zip(every, x, strict=True))
    return Fitted(classifier, summed, as_dict(present), as_dict(target), as_dict(reached), met)


def _with_rates(rows: DataFrame, fitted: Fitted, mix: Mix) -> DataFrame:
    """``rows`` with features, given ``__post`` and ``__rate``."""
    c = fitted.classifier
    rows = rows.withColumns({f"__b_{k}": b for k, b in c.binned({k: F.col(f"__f_{k}") for k in c.names}).items()})
    rows = c.with_posterior(rows, {k: F.col(f"__b_{k}") for k in c.names}, "__post")
    return rows.withColumn("__rate", _rate(F.col("__post"), fitted.summed, mix.min_rate))


def rated(docs: DataFrame, fitted: Fitted, mix: Mix = Mix(), text: str = "text") -> DataFrame:
    """``docs`` with ``__post`` and ``__rate`` of every row."""
    return _with_rates(with_features(docs, text, fitted.classifier.words), fitted, mix).select(*docs.columns, "__post", "__rate")


def _copies(doc_id: str) -> Column:
    """Whole part of the rate, and one more where the id's hash falls below the rest."""
    u = F.pmod(F.xxhash64(F.col(doc_id), F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    whole = F.floor("__rate")
    return (whole + F.when(u < F.col("__rate") - whole, 1).otherwise(0)).cast("int")


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", domain: str = "domain") -> DataFrame:
    """``doc_id, domain, probability, rate, copies`` of every row; ``domain`` is the likeliest one (ties: the first by name).

    Null texts are empty; repeated rows and null ids stay; an empty table gives an empty one.
    """
    rows, words = measured(docs, labelled, mix, doc_id, text, domain)
    fitted = fit_measured(rows, words, labelled, targets, mix, doc_id, domain)
    rows = _with_rates(rows, fitted, mix)
    top = F.array_max("__post")
    name = F.get(F.array(*[F.lit(d) for d in fitted.classifier.domains]), (F.array_position("__post", top) - 1).cast("int"))
    return rows.select("doc_id", name.alias("domain"), top.alias("probability"), F.col("__rate").alias("rate"), _copies("doc_id").alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", domain: str = "domain") -> DataFrame:
    """The rows of ``docs``, each as often as its rate says; with the default ``min_rate`` every row at least once."""
    # no filter where every row stays: pushed down, it would be expanded through all of the rate's expression
    rows = rated(docs, fit(docs, labelled, targets, mix, doc_id, text, domain), mix, text)
    if mix.min_rate < 1:
        rows = rows.filter(_copies(doc_id) > 0)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), _copies(doc_id)))).select(*docs.columns)


def totals(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", domain: str = "domain") -> DataFrame:
    """``domain, present, target, reached, met`` of every domain, in expected tokens; ``met`` is that of the whole fit."""
    f = fit(docs, labelled, targets, mix, doc_id, text, domain)
    return docs.sparkSession.createDataFrame([(d, f.present[d], f.target[d], f.reached[d], f.met) for d in f.classifier.domains], "domain string, present double, target double, reached double, met boolean")
