import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sysloom.llm import fingerprints as fp
from sysloom.llm.queries import op1_fingerprints

M = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def brute(text):
    """The parse of one text, a name at a time."""
    names, level, phrases = [mix((ord(c) + 0x51ED270B) & M) for c in text], 0, []
    while names:
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if k == 1 else mix((x * 0xD1342543DE82EF95 + k * 0xA0761D6478BD642F) & M) for x, k in runs]
        label = names
        for _ in range(4):
            out = []
            for i, x in enumerate(label):
                left = label[i - 1] if i else (x ^ M if label is names else x ^ 1)
                low = ((x ^ left) & -(x ^ left)).bit_length() - 1
                out.append(2 * low + (x >> low & 1))
            label = out
        cuts = [0] + [i for i in range(1, len(names) - 1) if label[i - 1] < label[i] > label[i + 1]]
        level += 1
        blocks = [names[a:b] for a, b in zip(cuts, cuts[1:] + [len(names)], strict=True)]
        assert all(len(b) <= 11 for b in blocks)
        place = [int(p) for p in fp.PLACES[:16]]
        names = [mix((sum(x * p for x, p in zip(b, place, strict=False)) & M) ^ (len(b) * 0xE7037ED1A0B428DB & M) ^ level) for b in blocks]
        if level > 1 or len(text) < fp.SHORT or len(names) == 1:
            phrases += names
        if len(names) == 1:
            break
    sketch = [0] * fp.BINS
    for b in range(fp.BINS):
        least = min((x << 6 & M for x in phrases if x >> 58 == b), default=None)
        if least is not None:
            sketch[b] = max(1, mix(least) & 0xFFFF)
    return (names[0] if names else 0), sketch


@settings(deadline=None, max_examples=120)
@given(st.lists(st.one_of(st.text(max_size=120), st.text("ab", max_size=200)), max_size=4))
def test_parse_against_brute_force(texts):
    top, sketch = fp.parse(texts)
    for t, a, b in zip(texts, top.tolist(), sketch.tolist(), strict=True):
        assert (a, b) == brute(t)


def test_offsets_do_not_matter():
    r = random.Random(1)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8)))
    body, other = " ".join(word() for _ in range(400)), " ".join(word() for _ in range(400))
    _, s = fp.parse([body, "xyz " + body, other, ""])
    assert fp.likeness(s[[0]], s[[1]])[0] > 0.9 and fp.likeness(s[[0]], s[[2]])[0] < 0.2
    assert fp.likeness(s[[3]], s[[3]])[0] == 1 and fp.likeness(s[[0]], s[[3]])[0] == 0


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    texts = [t for _, t in rows]
    out = []
    for k, (i, t) in enumerate(rows):
        following = texts[(k + 1) % len(texts)]
        e = fp.edited(t, following)
        top, s = fp.parse([t, e, following])
        text = fp.as_text(top, s)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), text[0], text[1], float(fp.likeness(s[[0]], s[[1]])[0]), float(fp.likeness(s[[0]], s[[2]])[0])))
    return sorted(out, key=repr)


def test_odd_rows(spark):
    rows = [(3, "same"), (3, "same"), (None, "x" * 5000), (1, None), (2, ""), (7, "é😀" * 40), (9, "a"), (8, "long text " * 9000)]
    docs = spark.createDataFrame([(i, t, "-") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(4)
    assert sorted(map(tuple, fp.compared_with_edits(docs).collect()), key=repr) == expected(rows)
    one = docs.filter("doc_id = 7")
    assert sorted(map(tuple, fp.compared_with_edits(one).collect()), key=repr) == expected([rows[5]])
    assert fp.compared_with_edits(docs.limit(0)).collect() == []
    assert fp.fingerprints(docs).count() == len(rows)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op1_fingerprints(spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)
    assert np.median([r.near_edited for r in got]) > 0.4 and np.median([r.near_next for r in got]) < 0.1
    assert (fp.sketch_of(got[0].fingerprint) == fp.sketch_of(got[0].fingerprint)).all()
