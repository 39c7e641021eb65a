import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sysloom.llm.packing import Chunks, batches, cut, packed
from sysloom.llm.queries import op12_packing, table, tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")
ODD = ["", " ", "\n\n", "It's, the END. (a,b).c!,", " lead", "trail ", "a  b   c\n\n d\t\te \n", "x  y \t\tz", "a   b", "　 　x", "été, à. ×. ÷, ñ!", "12,345.67 !!! ... ,", "<|endoftext|> a", "hello <|endoftext|> world.<|endoftext|>", "<|endoftext", "日本語。 中文, emoji 😀!", "don't we'll I'M 'rest. 's,", "x" * 5000, "a.b, c.\nd,\n", "\x00\x1c a\x1f b\x85 c", "a\r\n\r\nb", '"q," (r.) s?! t;: u']


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "a", "B.", " ", ",", "É", "\n", "\t", " ", " ", "́", "'s", "'", "×", "1", "\u0085", "　", "."]), max_size=14).map("".join)), min_size=1, max_size=5))
def test_chunks_equal_library(library, texts):
    ids, counts = Chunks(FILE)(pa.array(texts, pa.large_string()))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_the_public_file_is_encoded_by_chunks():
    assert Chunks(FILE).by_chunk and not Chunks(tokenizer_file("word_bpe_49k.json")).by_chunk


@given(st.lists(st.integers(1, 10_000), max_size=20), st.sampled_from([1, 16, 1024]))
def test_cuts_are_binary_digits(totals, limit):
    sizes, often = cut(np.array(totals, np.int64), limit)
    at = 0
    for n, k in zip(totals, often.tolist(), strict=True):
        own = sizes[at : at + k].tolist()
        assert sum(own) == n and own == sorted(own, reverse=True) and all(x & (x - 1) == 0 for x in own)
        assert own.count(limit) == n // limit and len(set(x for x in own if x < limit)) == len([x for x in own if x < limit])
        at += k
    assert at == len(sizes)


def check(rows, texts, library, limit=1024):
    """Every id of every document in one piece, sequences gapless and of one document, buckets numbered in turn."""
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        want = [sorted([*library.encode(t or "", add_special_tokens=False).ids, 0]) for t in texts[doc_id]]
        got = sorted((r for r in own), key=lambda r: r.start)
        assert sum(r.length for r in got) == sum(map(len, want))
        if len(want) == 1:
            ids = [*library.encode(texts[doc_id][0] or "", add_special_tokens=False).ids, 0]
            at = 0
            for r in got:
                assert (r.start, r.doc_tokens) == (at, len(ids))
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
    numbers = sorted((r.sequence_id, r.length, r.offset) for r in rows)
    assert [n for n, _, _ in numbers] == list(range(len(rows))) and {o for _, _, o in numbers} <= {0}
    assert [k for _, k, _ in numbers] == sorted((k for _, k, _ in numbers), reverse=True)
    assert all(k <= limit and k & (k - 1) == 0 for _, k, _ in numbers)


def test_query_against_library(spark, sf, library):
    texts = {r.doc_id: [r.text] for r in table(spark, sf, "documents").collect()}
    check(op12_packing(spark, sf).collect(), texts, library)


def test_odd_rows(spark, library):
    from pyspark.sql import functions as F

    rows = [(i, t, "z", 1) for i, t in enumerate(ODD)] + [(None, None, "z", 1), (3, ODD[3], "z", 1), (99, None, "z", 1), (100, "word, " * 30_000, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, part int").repartition(5)
    got = packed(docs, FILE, 0, limit=64).withColumn("ids_crc32", F.crc32("ids"))
    texts = defaultdict(list)
    for doc_id, text, *_ in rows:
        texts[doc_id].append(text)
    check(got.collect(), texts, library, 64)
    for r in batches(got, 256).groupBy("length", "batch").count().collect():
        assert r["count"] * r.length <= 256


def test_empty_table_and_other_lengths(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packed(docs, FILE, 0).collect() == []
    with pytest.raises(ValueError):
        packed(docs, FILE, 0, limit=1000)
