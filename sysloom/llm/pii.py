"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans. Four labelers vote on each: its structure (regex and checksum), a gazetteer (top-level
domains, card issuers, number plans, address ranges), its context (cue words just before it) and its shape.
Votes are counted over the whole corpus; expectation-maximisation on those counts, a table of fixed size,
estimates how far each labeler can be trusted for each kind, and a logistic span classifier is fitted to
the resulting posteriors, from the votes and from what a span itself looks like (length, groups of letters
and digits, its neighbours). It decides on the spans that the base patterns alone don't settle; the base
spans always stay. The patterns run once: spans are written, counted, and then judged where they lie.

Work within a text grows as n log n in its matches: places are running sums, made by doubling the distance
summed over, and overlaps are looked up by bisection.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("email", "ip", "card", "phone")
#: Base pattern of each kind. Quantifiers are possessive and starts are guarded, so a search takes linear time; the matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9]|[0-9][ -])[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser patterns; what they find counts only if the classifier says so.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[(\[{](?:at|AT)[)\]}] ?[A-Za-z0-9-]++ ?(?:\.|[(\[{](?:dot|DOT)[)\]}]) ?[A-Za-z]{2,}+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}+:){7}[0-9a-fA-F]{1,4}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9]|[0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
}
#: Cue words before a span of each kind, and words that speak against any.
CUES = {
    "email": "mail|contact|kontakt|contacto|courriel|correo|write to|schreib",
    "ip": r"\bip\b|host|server|serveur|servidor|address|adresse|connect|login|from",
    "card": "card|karte|carte|tarjeta|visa|master|amex|credit|kredit|payment|zahlung|pago",
    "phone": r"phone|\btel|call|mobile|\bfax|anruf|ruf|appel|llam|whatsapp|cell|handy",
}
AGAINST = r"version|\bv\.?$|isbn|issn|order|\bref|chapter|section|§|serial|sku|invoice|=\s*[\"']?$|[0-9a-f]{6}$"
#: Domain endings besides the two-letter ones, which all belong to countries.
DOMAINS = "com org net edu gov mil int info biz name pro mobi travel jobs museum dev app xyz online site shop store tech cloud blog email news agency live world group digital solutions services media design academy center company network systems"
VOTES = ("regex", "gazetteer", "context", "shape")
#: Traits of a span and their number of values: length in eights, groups of letters and digits, what stands on either side (nothing or a blank, letter or digit, other).
TRAITS = {"long": 4, "groups": 5, "left": 3, "right": 3}


def _vote(true: Column, false: Column) -> Column:
    """1 for, 0 against, -1 no opinion."""
    return F.when(true, 1).when(false, 0).otherwise(-1)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def valid(kind: str, hit: Column) -> Column:
    """Whether a match of the base pattern is kept."""
    n = F.length(_digits(hit))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
        "card": n.between(16, 19) & _luhn(_digits(hit)),
        "phone": n.between(8, 15),
    }[kind]


def _labelers(kind: str, loose: bool, hit: Column, before: Column, after: Column, ok: Column) -> list[Column]:
    digits, n = _digits(hit), F.length(_digits(hit))
    regex = {"card": _vote(_luhn(digits), ~_luhn(digits))}.get(kind, F.lit(-1)) if loose else _vote(ok, ~ok)
    octet = F.regexp_extract(hit, "^0*([0-9]{1,3})", 1)
    known = {
        "email": F.lower(F.regexp_extract(hit, "([A-Za-z]+)$", 1)).rlike("^[a-z]{2}$") | F.lower(F.regexp_extract(hit, "([A-Za-z]+)$", 1)).isin(DOMAINS.split()),
        "ip": F.lower(hit).rlike("^(?:2|3|fe80|fd)") if loose else ~octet.isin("0", "127", "255", "") & ok,
        "card": digits.rlike("^(?:4|5[0-8]|2[2-7]|3[04-9]|6011|6[2345])"),
        "phone": digits.rlike("^[2-9][0-9]{2}[2-9]") if loose else digits.rlike("^(?:1[2-9]|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"),
    }[kind]
    cue, against = F.lower(before).rlike(CUES[kind]), F.lower(before).rlike(AGAINST)
    shape = {
        "email": F.length(hit).between(6, 100),
        "ip": ~before.rlike(r"[0-9A-Za-z.]$") & ~after.rlike(r"^\.?[0-9A-Za-z]"),
        "card": hit.rlike("^[0-9]+$|^[0-9]{4}([ -])[0-9]{4,6}(?:\\1[0-9]{3,5})*$") & ~before.rlike("[0-9A-Za-z.]$") & ~after.rlike("^[0-9A-Za-z]"),
        "phone": n.between(10, 13) & ~after.rlike("^[0-9A-Za-z]"),
    }[kind]
    return [regex, _vote(known, ~known), _vote(cue & ~against, against), _vote(shape, ~shape)]


def scanned(array: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running value of ``step`` over ``array`` (an expression that skips a null second argument), in n log n steps:
    each round joins every element with the one twice as far back."""
    n = F.size(array)
    rounds = F.sequence(F.lit(0), F.length(F.bin(n - 1)) - 1)
    whole = F.aggregate(rounds, array, lambda acc, k: F.transform(acc, lambda x, i: step(x, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)))))
    return F.when(n > 1, whole).otherwise(array)


def _add(x: Column, y: Column) -> Column:
    return x + F.coalesce(y, F.lit(0))


def _advances(gaps: Column, hits: Column) -> Column:
    """How far each match starts after the match before it."""
    return F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(hits, i - 1)), F.lit(0)))


def _below(ordered: Column, bound: Column) -> Column:
    """How many elements of a rising array are less than ``bound``, by bisection."""
    n = F.size(ordered)
    bit = lambda k: F.call_function("shiftleft", F.lit(1), k)
    down = F.sequence(F.length(F.bin(n)) - 1, F.lit(0), F.lit(-1))
    return F.aggregate(down, F.lit(0), lambda at, k: F.when((at + bit(k) <= n) & (F.get(ordered, at + bit(k) - 1) < bound), at + bit(k)).otherwise(at))


def _side(c: Column) -> Column:
    return F.when(c.rlike("^[A-Za-z0-9]$"), 1).when(c.rlike(r"^\S$"), 2).otherwise(0)


def _proposal(kind: str, loose: bool, gaps: Column, starts: Column):
    """The struct that a match becomes, from its number among the matches."""

    def one(hit: Column, i: Column) -> Column:
        start = F.get(starts, i)
        before, after = F.right(F.get(gaps, i), F.lit(40)), F.left(F.get(gaps, i + 1), F.lit(4))
        ok = F.lit(False) if loose else valid(kind, hit)
        votes = _labelers(kind, loose, hit, before, after, ok)
        traits = {"long": F.least(F.lit(3), F.floor(F.length(hit) / 8)), "groups": F.least(F.lit(5), F.greatest(F.lit(1), F.regexp_count(hit, F.lit("[A-Za-z0-9]+")))) - 1, "left": _side(F.right(before, F.lit(1))), "right": _side(F.left(after, F.lit(1)))}
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), ok.alias("base"), F.lit(loose).alias("loose"), *[v.cast("int").alias(n) for v, n in zip(votes, VOTES, strict=True)], *[v.cast("int").alias(n) for n, v in traits.items()])

    return one


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the array column ``__spans``: every match of every pattern, with place, worth and votes.

    Matches and the text between them alternate, so running sums of lengths give each match's place in code points.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    guard = {
        ("email", False): F.instr(body, "@") > 0, ("ip", False): body.rlike(BASE["ip"]), ("card", False): body.rlike("[0-9](?:[ -]?[0-9]){15}"), ("phone", False): F.instr(body, "+") > 0,
        ("email", True): body.rlike(r"[(\[{](?:at|AT)[)\]}]"), ("ip", True): body.rlike("[0-9a-fA-F]:(?:[0-9a-fA-F]{1,4}:){6}"), ("card", True): body.rlike("[0-9](?:[ -]?[0-9]){12}"), ("phone", True): body.rlike("[0-9]{3}[.-][0-9]{4}"),
    }
    tagged = [(k, loose) for loose in (False, True) for k in KINDS]
    name = lambda k, loose, what: f"__{what}_{k}_{'loose' if loose else 'base'}"
    cuts, starts = {}, {}
    for k, loose in tagged:
        pattern = (LOOSE if loose else BASE)[k]
        gaps, hits = name(k, loose, "gaps"), name(k, loose, "hits")
        cuts[gaps] = F.when(guard[k, loose], F.split(body, pattern, -1))
        cuts[hits] = F.when(guard[k, loose], F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
        starts[name(k, loose, "starts")] = scanned(_advances(F.col(gaps), F.col(hits)), _add)
    rows = docs.withColumns(cuts).withColumns(starts)
    arrays = []
    for k, loose in tagged:
        found = F.transform(F.col(name(k, loose, "hits")), _proposal(k, loose, F.col(name(k, loose, "gaps")), F.col(name(k, loose, "starts"))))
        arrays.append(F.coalesce(found, F.array()))
    rows = rows.withColumn("__spans", F.concat(*arrays)).drop(*cuts, *starts)
    # a match that is not base and overlaps a base span adds nothing: of the base spans that start before its end, none may reach past its start
    base = F.array_sort(F.transform(F.filter("__spans", lambda s: s["base"]), lambda s: F.struct(s["start"], s["end"])))
    rows = rows.withColumn("__base", F.when(F.exists("__spans", lambda s: ~s["base"]), base))
    rows = rows.withColumns({"__starts": F.transform("__base", lambda b: b["start"]), "__ends": scanned(F.transform("__base", lambda b: b["end"]), F.greatest)})
    free = lambda s: F.coalesce(F.get("__ends", _below(F.col("__starts"), s["end"]) - 1) <= s["start"], F.lit(True))
    fresh = F.filter("__spans", lambda s: s["base"] | free(s))
    return rows.withColumn("__spans", F.when(F.col("__base").isNull(), F.col("__spans")).otherwise(fresh)).drop("__base", "__starts", "__ends")


# ---- reliabilities and classifier, on a table of at most kinds x votes x flags rows ---------------------
def expectation_maximisation(counts: dict[tuple, float], rounds: int = 40) -> tuple[dict[tuple, float], dict]:
    """Posterior of every (kind, votes) and each labeler's rates of votes under both classes.

    ``counts``: (kind, votes) -> spans. Labelers start out as right in four of five cases (structure: 19 of 20),
    which fixes which class is which, and pseudo-counts keep rates off 0 and 1.
    """
    start = {"regex": 0.95, "gazetteer": 0.8, "context": 0.8, "shape": 0.8}
    rates = {(k, l, c): {1: start[l] if c else 1 - start[l], 0: 1 - start[l] if c else start[l]} for k in range(len(KINDS)) for l in VOTES for c in (0, 1)}
    prior = dict.fromkeys(range(len(KINDS)), 0.5)
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for key in counts:
            kind, votes = key
            log = [math.log(1 - prior[kind]), math.log(prior[kind])]
            for l, v in zip(VOTES, votes, strict=True):
                if v >= 0:
                    for c in (0, 1):
                        log[c] += math.log(rates[kind, l, c][v])
            posterior[key] = 1 / (1 + math.exp(max(-700.0, min(700.0, log[0] - log[1]))))
        for k in prior:
            own = [(key[1], n, posterior[key]) for key, n in counts.items() if key[0] == k]
            weight = sum(n for _, n, _ in own)
            prior[k] = (sum(n * p for _, n, p in own) + 1) / (weight + 2)
            for i, l in enumerate(VOTES):
                for c in (0, 1):
                    # ten pseudo-votes at the starting rates
                    n = {v: 10 * (start[l] if (v == 1) == bool(c) else 1 - start[l]) for v in (0, 1)}
                    for votes, m, p in own:
                        if votes[i] >= 0:
                            n[votes[i]] += m * (p if c else 1 - p)
                    rates[k, l, c] = {v: n[v] / (n[0] + n[1]) for v in n}
    return posterior, rates


#: Place of the weights: kinds, looseness, votes 0 and 1, values of the traits within each kind.
_VOTE_AT = len(KINDS) + 1
_TRAIT_AT = _VOTE_AT + 2 * len(VOTES)
_TRAIT_SIZE = sum(TRAITS.values())
N_FEATURES = _TRAIT_AT + len(KINDS) * _TRAIT_SIZE


def _features(kind: int, loose: bool, votes: tuple, traits: tuple) -> list[int]:
    """Indices of the features that are 1."""
    at, out = _TRAIT_AT + kind * _TRAIT_SIZE, []
    for v, n in zip(traits, TRAITS.values(), strict=True):
        out.append(at + v)
        at += n
    return [kind, *([len(KINDS)] if loose else []), *(_VOTE_AT + 2 * i + v for i, v in enumerate(votes) if v >= 0), *out]


@dataclass(frozen=True)
class SpanClassifier:
    """Weights of kind, looseness, votes and traits; ``reliability`` is what expectation-maximisation found."""

    weights: tuple[float, ...]
    reliability: dict

    def accepts(self, span: Column) -> Column:
        pick = lambda values, i: F.coalesce(F.get(F.array(*[F.lit(float(v)) for v in values]), i), F.lit(0.0))
        w = self.weights
        z = pick(w[: len(KINDS)], span["kind"]) + F.when(span["loose"], w[len(KINDS)]).otherwise(0.0)
        for i, name in enumerate(VOTES):
            z = z + pick(w[_VOTE_AT + 2 * i : _VOTE_AT + 2 * i + 2], span[name])
        at = 0
        for name, n in TRAITS.items():
            own = [w[_TRAIT_AT + k * _TRAIT_SIZE + at + v] for k in range(len(KINDS)) for v in range(n)]
            z = z + pick(own, span["kind"] * n + span[name])
            at += n
        return z >= 0


def fit(rows: DataFrame, steps: int = 400) -> SpanClassifier:
    """Count the votes and traits on all ``__spans`` of ``rows`` (``candidates``, written) and learn from the counts.

    At most 4 x 2 x 81 x 180 rows leave Spark, whatever the size of the corpus.
    """
    spans = rows.select(F.explode("__spans").alias("s")).select("s.*")
    found = spans.groupBy("kind", "loose", *VOTES, *TRAITS).agg(F.count("*").alias("n")).collect()
    table = sorted((r.kind, r.loose, tuple(r[v] for v in VOTES), tuple(r[t] for t in TRAITS), r.n) for r in found)
    counts: dict[tuple, float] = {}
    for kind, _, votes, _, n in table:
        counts[kind, votes] = counts.get((kind, votes), 0) + n
    posterior, rates = expectation_maximisation(counts)
    # weighted logistic regression on the posteriors; counts enter by their root so no frequent pattern drowns the rest
    on = [_features(*row[:4]) for row in table]
    at, feature = np.repeat(np.arange(len(table)), [len(f) for f in on]), np.array([i for f in on for i in f], np.int64)
    goal, weight = np.array([posterior[r[0], r[2]] for r in table]), np.sqrt(np.array([r[4] for r in table], float))
    weight = weight / max(weight.sum(), 1.0)
    w = np.zeros(N_FEATURES)
    for _ in range(steps):
        z = np.bincount(at, w[feature], len(table))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal) * weight
        w -= 1.0 * (np.bincount(feature, error[at], N_FEATURES) + 1e-3 * w)
    return SpanClassifier(tuple(w.tolist()), rates)


def find(rows: DataFrame, classifier: SpanClassifier) -> DataFrame:
    """``rows`` (``candidates``) with ``__spans`` cut down to the base spans and those that the classifier adds, by kind and start."""
    kept = F.filter("__spans", lambda s: s["base"] | classifier.accepts(s))
    slim = F.transform(kept, lambda s: F.struct(s["kind"], s["start"], s["end"], s["base"]))
    return rows.withColumn("__spans", F.array_sort(slim))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: int):
    return lambda s: s["kind"] == kind


def pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row (counts and hash: base spans).

    Null texts have no spans; repeated rows and null ids stay; an empty table gives an empty one; further columns are not read.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(candidates(source, "text").select("doc_id", "__spans"), "spans")
    rows = find(rows, fit(rows)).withColumn("__base", F.filter("__spans", lambda s: s["base"]))
    counts = [F.size(F.filter("__base", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.col("__spans")).alias("spans"))


#: Characters of the stretches that a text is cut into, so that any part of it is reached without walking from its start.
STRETCH = 512


def _cut(stretches: Column, a: Column, b: Column) -> Column:
    """Characters ``a`` to ``b`` (exclusive) of the text that ``stretches`` makes up."""
    first, last = F.floor(a / STRETCH).cast("int"), F.floor((b - 1) / STRETCH).cast("int")
    inner = F.array_join(F.slice(stretches, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    two = F.concat(F.substring(F.get(stretches, first), a % STRETCH + 1, F.lit(STRETCH)), inner, F.substring(F.get(stretches, last), F.lit(1), (b - 1) % STRETCH + 1))
    return F.when(b <= a, "").when(first == last, F.substring(F.get(stretches, first), a % STRETCH + 1, b - a)).otherwise(two)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; where spans overlap, the first kind listed stands for all.

    Null texts stay null; rows, repeated ones too, stay as they are; an empty table gives an empty one.
    """
    rows = written(candidates(docs, text), "spans")
    rows = find(rows, fit(rows))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    rows = rows.withColumn("__ordered", F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"], s["kind"], s["end"]))))
    some = F.size("__spans") > 0
    rows = rows.withColumns({"__tops": scanned(F.transform("__ordered", lambda s: s["end"]), F.greatest), "__stretches": F.when(some, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)))})
    done, stretches = (lambda i: F.coalesce(F.get("__tops", i - 1), F.lit(0))), F.col("__stretches")
    parts = F.transform("__ordered", lambda s, i: F.when(s["start"] >= done(i), F.concat(_cut(stretches, done(i), s["start"]), F.get(tags, s["kind"]))).otherwise(""))
    whole = F.concat(F.array_join(parts, ""), _cut(stretches, done(F.size("__tops")), F.length(F.col(text))))
    return rows.withColumn(text, F.when(some, whole).otherwise(F.col(text))).select(*docs.columns)
