import re
import zlib
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sysloom.llm.queries import op13_spelling, table
from sysloom.llm.variants import Runs, Variants, neighbours, node_pairs, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def edited(doc_id, text):
    out = []
    for run in RUN.findall(text or ""):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
        out.append(w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w)
    return out


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, letters=6, least=5, ratio=5):
    n = Counter(w for i, t in rows for w in edited(i, t) if len(w) >= letters)
    n = {w: c for w, c in n.items() if c >= least}
    by_length, out, form = {}, [], {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    all_near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)] for w in n}
    for w in n:
        if all_near[w]:
            best = min(all_near[w], key=lambda v: (-n[v], v))
            form[w] = best if n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(all_near[w]), n[form[w]] if form.get(w) else None))
    return sorted(out, key=lambda r: r[0])


def told(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=lambda r: r[0])


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 10**6)), st.text(alphabet="aBzZÀÿ×÷é \n.1ŁǍ日", max_size=60)), max_size=8))
def test_edited_words(rows):
    s = Variants(letters=1, every=3)
    runs = Runs(pa.array([t for _, t in rows], pa.large_string()))
    want = Counter()
    for i, t in rows:
        for run in RUN.findall(t):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w
            want[w] += bool(w)
    assert +runs.edited(["" if i is None else str(i) for i, _ in rows], s) == +want


def test_long_words_have_the_same_checksum():
    words = ["a" * k for k in (63, 64, 65, 700)]
    got = Runs(pa.array([" ".join(words)] * 300, pa.large_string())).edited([str(i) for i in range(300)], Variants())
    want = Counter(w for i in range(300) for w in edited(i, " ".join(words)))
    assert got == want


def test_equal_paths_have_equal_numbers():
    p, s, at, word, kind = node_pairs(["banana", "xbanana", "banan"])
    meets = {(int(w), int(a)): (x, y) for w, a, x, y, k in zip(word, at, p, s, kind) if k == 0}
    assert meets[0, 5][0] == meets[2, 5][0] and meets[0, 0][1] == meets[1, 1][1]
    assert len({x for x, _ in meets.values()}) == len({"banana"[:i] for i in range(7)} | {"xbanana"[:i] for i in range(8)})


def test_neighbours_are_all_pairs_one_letter_apart(spark):
    import itertools

    words = ["".join(x) for k in (1, 2, 3, 4) for x in itertools.product("abb"[:2], repeat=k)] + ["aac", "ÿa", "aÿ", "a" * 3000, "a" * 2999, "a" * 1500 + "b" + "a" * 1499]
    got = sorted((r.a, r.b) for r in neighbours(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect())
    assert got == sorted((a, b) for a in words for b in words if near(a, b))


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = brute(rows)
    assert told(op13_spelling(spark, sf)) == want
    assert any(w[1] for w in want)


def test_forms_ties_and_odd_rows(spark):
    words = {"kitten": 2000, "kittem": 90, "kittex": 90, "kitxem": 9, "mittens": 5, "mitten": 400, "sittten": 6, "letter": 30, "better": 30, "bettex": 6, "éclair": 40, "éclaír": 5, "Éclair": 5}
    rows = [(i, " ".join(w for w in words if i < words[w]), "z", 1) for i in range(2000)]
    rows += [(None, "Kitten KITTEN", "z", 1), (5, None, "z", 1), (6, "", "z", 1), (7, "kitten" * 40_000, "z", 1), (7, rows[7][1], "z", 1)]
    rows += [(3000 + i, "q" * 9000, "z", 1) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(6)
    got = told(variants(df))
    assert got == brute([r[:2] for r in rows])
    by = {r[0]: r for r in got}
    assert by["kitxem"][1:3] == ("kittem", "kitten") and by["bettex"][1] == "better"


def test_empty_table(spark):
    assert variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_table_is_broadcast(spark):
    """The words grow with the texts, so none of the joins may gather them in the driver, however small Spark takes them to be."""
    rows = [(i, " ".join(w for w, n in (("kitten", 300), ("kittem", 60), ("kittex", 9), ("kittens", 7), ("better", 30)) if i < n)) for i in range(300)]
    limit = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        got = told(variants(spark.createDataFrame(rows, "doc_id long, text string")))
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", limit)
    assert got == brute(rows) and any(r[1] for r in got)
