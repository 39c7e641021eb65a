import sentencepiece

import corpus_pipeline
from sysloom.llm import minhash, pii
from sysloom.llm.queries import tokenizer_file
from sysloom.llm.shared import written
from sysloom.llm.toxicity import fit_machine, scored

from .test_minhash import brute


def test_stages_against_their_definitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], sf), f"t-{name}"))
    by_id = [{r.doc_id: r for r in s.collect()} for s in seen]
    assert all(s.columns == docs.columns for s in seen[:-1])
    # toxicity: what scores one half and more goes, all else stays
    score = {r.doc_id: r.score for r in scored(docs, fit_machine(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert by_id[1].keys() == {i for i, s in score.items() if s < 0.5}
    # near-duplicates: the smallest id of each class by comparing all pairs
    classes, _ = brute([(i, r.text) for i, r in by_id[1].items()])
    assert by_id[2].keys() == {c for _, c in classes}
    assert all(by_id[2][i] == by_id[1][i] for i in by_id[2])
    # personal data: same rows, no base span is left
    assert by_id[3].keys() == by_id[2].keys()
    left = pii.candidates(seen[3], "text").selectExpr("doc_id", "exists(__spans, s -> s.base) AS left").filter("left").collect()
    assert not left
    # mixing: no row is lost
    assert by_id[4].keys() == by_id[3].keys() and all(by_id[4][i] == by_id[3][i] for i in by_id[4])
    # encoding: every row, and texts come back
    assert seen[5].count() == seen[4].count()
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert all(r.ids == library.encode(by_id[4][i].text) for i, r in by_id[5].items())
    assert minhash.Near().least == 0.8


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "ids", "n_tokens"]


def test_stages_on_odd_rows_and_empty_tables(spark, sf):
    """Null ids and texts, repeated ids with other texts, and no rows at all pass every stage; columns stay those of documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = docs.orderBy("doc_id").select("text").limit(2).collect()
    rows = [(1, a.text, "en", "s", 1), (1, b.text, "en", "s", 1), (2, None, None, None, None), (3, "", "de", "s", 0), (None, "mail me at x.y@example.com now", "en", "s", 1), (None, None, "en", "s", 0), (4, "a@b.cc " * 3000, "en", "s", 1)]
    odd = spark.createDataFrame(rows, docs.schema)
    for given, n in ((odd, 7), (docs.limit(0), 0)):
        seen = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = written(stage(spark, seen, sf), f"t-{name}")
            assert seen.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, seen, sf).collect()
        assert (len(last) > 0) == (n > 0)
        assert not any("@" in (r.text or "") for r in seen.collect())
