"""Documents to token ids: toxicity, near-duplicates, personal data, mixing, SentencePiece.

Every stage takes all that the one before it kept, as a table read from Parquet. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sysloom.llm import minhash, mixing, pieces, pii
from sysloom.llm import toxicity as tox
from sysloom.llm.queries import domains, table, tokenizer_file
from sysloom.llm.shared import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under one half; the machine is fitted on labelled rows of this stage's input."""
    machine = tox.fit_machine(docs, table(spark, sf_dir, "labels"))
    return tox.scored(docs, machine, keep=tuple(docs.columns)).filter("score < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of near-duplicates, that of the smallest id."""
    return minhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the spans of personal data replaced by their kind."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, those of domains below their target weight more than once."""
    return mixing.mixed(docs, domains(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens`` of every row."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("sentencepiece", encode)]

#: SQL has no word for the fitted classifiers, consistent sampling or the piece search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
