import hashlib
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sysloom.llm.pii import KINDS, candidates, expectation_maximisation, fit, pii, redacted, scanned
from sysloom.llm.queries import op5_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    s = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        s += d - 9 * (d > 9)
    return s % 10 == 0


def base(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check(rows, got):
    assert len(rows) == len(got)
    key = lambda r: (r[0] is None, r[0] or 0)
    for (i, t), r in zip(sorted(rows, key=key), sorted(got, key=key), strict=True):
        want = base(t)
        assert r.doc_id == i
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w[0] == k for w in want) for k in KINDS], t
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), t
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


ODD = [
    None, "", "a@b.com_x@y.org.z a@b a@b.c..d @x.y", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 0001.02.3.255 1.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 0", "12  4111 1111 1111 1111  34",
    "+1 (988) 555-2485 +49-1 +123456789012345678 +1((((((2", "é😀 mail x.y@z.de, tel +34 600 100 200.", "9" * 3000, "x" * 60000 + " q@r.st", "(988) 555-2485 call me (212) 555-0100", "1" * 15 + " " + "2 " * 40,
]


def test_odd_rows(spark):
    rows = list(enumerate(ODD)) + [(None, "z@z.zz"), (2, ODD[2])]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    check(rows, pii(docs).collect())
    assert pii(docs.limit(0)).collect() == []


@settings(deadline=None, max_examples=3, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "@", ".", "1", "23", " ", "-", "+", "(", ")", "x.y@z", "4111111111111111", "10.0.0.1", "é"]), max_size=25).map("".join), min_size=30, max_size=60))
def test_base_spans_against_brute_force(spark, texts):
    rows = list(enumerate(texts))
    check(rows, pii(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_method_adds_spans_and_keeps_decoys_out(spark):
    good = [f"word call (2{i:02d}) 555-01{i:02d} or mail a{i}.b@mail.example.com now, +1 (212) 555-0{i:03d}, card 4111 1111 1111 1111" for i in range(40)]
    decoy = [f"version 10.{i}.300.4 order 4111 1111 1111 11{i:02d}" for i in range(40) if not luhn(f"41111111111111{i:02d}")]
    docs = spark.createDataFrame(list(enumerate(good + decoy)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii(docs).collect()}
    assert all(len(got[i].spans.split(",")) == 4 for i in range(40))
    assert all(got[40 + i].spans == "" for i in range(len(decoy)))
    text = {r.doc_id: r.text for r in redacted(docs).collect()}
    assert text[3] == "word call [PHONE] or mail [EMAIL] now, [PHONE], card [CARD]" and text[41] == decoy[1]


def test_em_finds_the_unreliable_labeler():
    counts = {(0, (1, 1, 1, 0)): 300, (0, (1, 1, 1, 1)): 300, (0, (0, 0, 0, 1)): 200, (0, (0, 0, 0, 0)): 200, (0, (0, 1, 0, 1)): 20}
    posterior, rates = expectation_maximisation(counts)
    assert posterior[0, (1, 1, 1, 0)] > 0.9 and posterior[0, (0, 0, 0, 1)] < 0.1
    assert abs(rates[0, "shape", 1][1] - 0.5) < 0.1 < rates[0, "regex", 1][1] - rates[0, "regex", 0][1]


def test_no_python_in_the_plan(spark, sf):
    plan = op5_pii(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert fit(candidates(spark.read.parquet(f"{sf}/documents.parquet"), "text")).weights


@pytest.mark.parametrize("size", ["sf0.001"])
def test_query(spark, size):
    folder = f"/root/testdata/{size}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(rows, op5_pii(spark, folder).collect())


def brute_redacted(text, spans):
    """Replace spans one after the other; spans that overlap what went before only lengthen it."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(","))), key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_redaction_against_brute_force(spark):
    long = ("lorem ipsum é😀 " * 90 + "mail a.b@c.de now ") * 4 + "tail " * 300
    texts = ODD + [long, "ip 10.20.30.40@mail.example.com +10.20.30.40 x", "+4111 1111 1111 1111 call +1 (988) 555-2485", long]
    rows = [(i, t, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], None, 2), (None, "a@b.cc", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, start int")
    spans = {(r.doc_id): r.spans for r in pii(docs).collect()}
    got = redacted(docs).collect()
    assert len(got) == len(rows) and list(got[0].asDict()) == ["doc_id", "text", "kind", "start"]
    for r in got:
        want = next(t for i, t, _, n in rows if (i, n) == (r.doc_id, r.start))
        assert r.text == (None if want is None else brute_redacted(want, spans[r.doc_id]))
    assert redacted(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 63, 64, 65, 1000])
def test_running_values(spark, n):
    x = [(i * 7919) % 101 for i in range(n)]
    row = spark.createDataFrame([(x,)], "x array<int>").select(scanned(F.col("x"), lambda a, b: a + F.coalesce(b, F.lit(0))).alias("s"), scanned(F.col("x"), F.greatest).alias("m")).first()
    assert row.s == [sum(x[: i + 1]) for i in range(n)] and row.m == [max(x[: i + 1]) for i in range(n)]


def test_work_is_near_linear_in_matches(spark):
    """100,000 addresses in one text, of two kinds that overlap, within seconds."""
    text = " ".join(f"user{i}@mail{i % 977}.example.com (212) 555-0{i % 1000:03d}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii(docs.limit(0)).collect()
    start = time.monotonic()
    got = pii(docs).first()
    whole = redacted(docs).first().text
    assert time.monotonic() - start < 90
    check([(1, text)], [got])
    assert whole == brute_redacted(text, got.spans)
