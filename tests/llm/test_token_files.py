import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sysloom.llm.batches import pieces
from sysloom.llm.queries import op6_token_files, tokenizer_file
from sysloom.llm.shared import shared_dir
from sysloom.llm.token_files import Words, pack, read_token_files, token_digests, unpack, write_token_files

FILE = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_coding_round_trip(values):
    v = np.array(values, np.uint32)
    assert unpack(*pack(v), len(v)).tolist() == values


ODD = ["", " ", "\n\n", "It's, the END. (a,b).c!,", "été, Ünïcode. İstanbul ΑΣ Σ.", "H̱ó é", "naïve wide\x85x\x1cy", "12,345.67 !!! ... ,", "<|endoftext|> a", "hello <|endoftext|> world", "x<|startoftext|>y.<|endoftext|>, z", "<|ENDOFTEXT|> <|EndOfText|>, a <|startoftext|", "A<|endoftext|>. B", "日本語。 中文, emoji 😀!", "don't we'll I'M", "x" * 5000, "a.b, c.\nd,\n"]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "a", "B.", " ", ",", "É", "\n", "\u0301", "'s"]), max_size=12).map("".join)), min_size=1, max_size=5))
def test_words_equal_library(library, texts):
    ids, counts = Words(FILE)(pa.array(texts, pa.large_string()))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_odd_rows(spark, library):
    rows = [(i, t, "z") for i, t in enumerate(ODD)] + [(None, None, "z"), (3, ODD[3], "z"), (99, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = shared_dir(spark, "t")
    write_token_files(docs, path, FILE, 2)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for g, (doc_id, text, _) in zip(got, want, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (doc_id, at, len(ids), ids)
        at += len(ids)


def test_empty_table(spark):
    path = shared_dir(spark, "t")
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, FILE, 2)
    assert token_digests(spark, path).collect() == []


def test_query_against_library(spark, sf, library):
    got = {r.doc_id: r for r in op6_token_files(spark, sf).collect()}
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    at = 0
    for d in docs:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        g = got[d.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_special_names_give_their_ids():
    ids, counts = Words(FILE)(pa.array(["hello <|endoftext|> world", "<|startoftext|>"], pa.large_string()))
    assert counts.tolist() == [3, 1] and ids[1] == 49407 and ids[3] == 49406


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("aB .\n<|>endoftx", max_size=30)), min_size=1, max_size=4))
def test_other_tokenizers_encode_whole_texts(texts):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    other = Words(path)
    assert not other.by_word and Words(FILE).by_word
    ids, counts = other(pa.array(texts, pa.large_string()))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_later_pieces_of_a_batch(library, kind):
    texts = [*ODD, "Été. À la fin, É", "naïve", *ODD]
    ids, at = Words(FILE), 0
    for lo, hi, own in pieces(pa.array(["cut off", *texts], kind).slice(1), 40):
        own.validate(full=True)
        got, counts = ids(own)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts[lo:hi]]
        assert got.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
        at = hi
    assert at == len(texts)
