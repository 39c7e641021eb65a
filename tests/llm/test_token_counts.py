import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sysloom.llm.queries import op10_token_counts, tokenizer_file
from sysloom.llm.token_counts import WORD_START, Automaton, token_counts

FILE = tokenizer_file("piece_bpe_32k.model")


def greedy(vocabulary, word):
    """Brute force: at each place the longest piece, else the character's bytes."""
    n = at = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in vocabulary:
                n, at = n + 1, end
                break
        else:
            n, at = n + len(word[at].encode()), at + 1
    return n


@settings(deadline=None, max_examples=300)
@given(st.sets(st.text("abé", min_size=1, max_size=5), max_size=12), st.text("abéc", max_size=14))
def test_automaton_is_greedy(vocabulary, word):
    assert Automaton(vocabulary).count(word) == greedy(vocabulary, word)


@pytest.fixture(scope="module")
def vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=FILE)
    return {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}


def whole(vocabulary, text):
    return sum(greedy(vocabulary, WORD_START + w) for w in (text or "").split())


def test_odd_rows(spark, vocabulary):
    texts = [None, "", "  \n ", "a", "日本 😀 x́y", "ab " * 3000, "z" * 4000, "a"]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in token_counts(docs, FILE).collect())
    assert got == [(i, len((t or "").split()), whole(vocabulary, t)) for i, t in enumerate(texts)]
    assert token_counts(docs.limit(0), FILE).collect() == []


def test_query(spark, sf, vocabulary):
    got = {r.doc_id: r for r in op10_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert (got[d.doc_id].n_words, got[d.doc_id].n_tokens) == (len(d.text.split()), whole(vocabulary, d.text))
