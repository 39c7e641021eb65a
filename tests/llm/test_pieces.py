import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sysloom.llm.pieces import MARK, Model, decode, encode, merged
from sysloom.llm.queries import op3_sentencepiece, tokenizer_file

FILE = tokenizer_file("piece_bpe_32k.model")
ODD = ["", " ", "   a  b ", "The cat.\n\nsat on", "\n a\n", "日本語 😀 naïve", "x" * 700, "for    while", "\t\x00\x01", "été à l'Été", "a▁b", "1234567890 " * 40, *(" " * k + "the" for k in range(40))]


def rewritten(path, change):
    """The public file with one of its settings changed, as an oracle of other kinds of models."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    x = pb.ModelProto()
    with open(FILE, "rb") as f:
        x.ParseFromString(f.read())
    change(x)
    path.write_bytes(x.SerializeToString())
    return str(path)


@pytest.fixture(scope="module")
def model():
    return Model(FILE)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    g = random.Random(3)

    def change(x):
        x.trainer_spec.model_type = 1
        for p in x.pieces:
            if p.type == 1:
                p.score = -1 - 8 * g.random() * len(p.piece) ** 0.5

    path = rewritten(tmp_path_factory.mktemp("models") / "unigram.model", change)
    return Model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def ids_of(model, texts):
    ids, counts = model.encode(pa.array(texts, pa.large_string()))
    ends = np.cumsum(counts)
    return [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)]


def back(model, rows):
    return model.decode(np.array([i for r in rows for i in r], np.int64), np.array([len(r) for r in rows], np.int64)).to_pylist()


TEXTS = st.one_of(st.text(max_size=30), st.text("the anction \n", max_size=40), st.text(" ▁a\n1", max_size=30))


@settings(deadline=None, max_examples=150)
@given(st.lists(TEXTS, max_size=4))
def test_ids_are_the_librarys(model, library, texts):
    got = ids_of(model, texts)
    assert got == library.encode(texts)
    assert back(model, got) == [t.replace(MARK, " ") for t in texts]


def test_odd_and_whole_documents(spark, sf, model, library):
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert ids_of(model, texts) == library.encode(texts)
    assert ids_of(model, texts[::-1]) == library.encode(texts[::-1])  # with units kept from before


@settings(deadline=None, max_examples=100)
@given(st.text("the actionsabout", max_size=24))
def test_merges(library, text):
    score = {library.id_to_piece(i): library.get_score(i) for i in range(259, library.get_piece_size())}
    assert merged(MARK + text.replace(" ", MARK), score) == [library.id_to_piece(i) for i in library.encode(text)] or not text


def long_runs():
    g = random.Random(6)
    letters = "etaoinshrdlu"
    return ["a" * 2000, "=" * 1999, "".join(g.choice("ACGT") for _ in range(2000)), "".join(g.choice(letters) for _ in range(2000)), "the" * 900, "日本" * 500, "aあ" * 700, "ab" * 20_000, "".join(g.choice(letters) for _ in range(50_000))]


def test_long_unbroken_runs(model, library):
    """Runs over several stretches, alone and with short words of every length beside them."""
    assert ids_of(model, long_runs()) == [library.encode(t) for t in long_runs()]
    mixed = [" ".join(["word", t, "x" * k]) for k, t in enumerate(long_runs())]
    assert ids_of(model, mixed) == [library.encode(t) for t in mixed]


@pytest.mark.parametrize("of", ["a", "ACGT", "etaoinshrdlu"])
def test_a_megabyte_without_a_break_takes_seconds(model, of):
    g = random.Random(7)
    text, began = "".join(g.choices(of, k=1 << 20)), time.process_time()
    (ids,) = ids_of(model, [text])
    assert time.process_time() - began < 60
    assert back(model, [ids]) == [text]


def test_matrix_and_walk_agree(model, unigram):
    g = random.Random(8)
    parts = ["".join(g.choice("abeinst日") for _ in range(12)) for _ in range(300)]
    for m in (model, unigram[0]):
        assert m._walk(parts) == m._equal("".join(parts), 12)


def test_unigram_scores_are_maximal(spark, sf, unigram):
    """Equal totals may be cut in another order, so those texts are compared by their totals."""
    m, sp = unigram
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()][:60]
    total = lambda ids: sum(sp.get_score(i) for i in ids)
    same = 0
    for got, want in zip(ids_of(m, texts), sp.encode(texts), strict=True):
        same += got == want
        assert got == want or total(got) == pytest.approx(total(want), rel=1e-6)
    assert same > len(texts) * 0.6


def test_other_models_are_refused(tmp_path):
    def dummy(x):
        x.normalizer_spec.add_dummy_prefix = False

    def spaces(x):
        x.normalizer_spec.remove_extra_whitespaces = True

    def words(x):
        x.trainer_spec.model_type = 3

    for i, change in enumerate((dummy, spaces, words)):
        with pytest.raises(ValueError):
            Model(rewritten(tmp_path / f"{i}.model", change))


def test_bytes_that_are_no_text(model):
    assert back(model, [[int(model.byte_id[0xC3])], [], [int(model.byte_id[0xC3]), int(model.byte_id[0xA9])]]) == ["�", "", "é"]


def test_odd_rows(spark, library):
    rows = [(i, t, 0) for i, t in enumerate(ODD)] + [(None, None, 0), (3, ODD[3], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = encode(docs, FILE)
    key = lambda r: (r[0] is None, r[0])
    for r, (i, t, _) in zip(sorted(got.collect(), key=key), sorted(rows, key=key), strict=True):
        assert (r.doc_id, r.ids, r.n_tokens) == (i, library.encode(t or ""), len(r.ids))
    again = sorted(((r.doc_id, r.text) for r in decode(got, FILE).collect()), key=key)
    assert again == sorted([(i, (t or "").replace(MARK, " ")) for i, t, _ in rows], key=key)
    assert encode(docs.limit(0), FILE).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in decode(nulls, FILE).collect()) == [(1, ""), (2, "")]


def test_query_round_trip(spark, sf, library):
    got = {r.doc_id: r for r in op3_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest() for d in docs)
    assert all(got[d.doc_id].ids == library.encode(d.text or "") for d in docs)
