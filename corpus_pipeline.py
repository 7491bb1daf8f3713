"""From raw documents to token ids: language, near copies, secrets, mixture, SentencePiece.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; each is
written as Parquet to the shared folder and read again as the next one's documents.  All but the last
return the columns of documents.

In every stage columns ride along, whatever their names, and no rows give no rows.  Null texts, and those
without a letter, go in the first stage; a null doc_id or source is a value like others.  Rows that repeat
each other share their fate in all stages but the second, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronovox.llm import jaccard, langid, mixing, secrets, sentencepiece_bpe
from chronovox.llm.common import forget, saved, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty; the others go."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity of 0.8 or more)."""
    return jaccard.representatives(docs, words=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate and its own coin say."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, as counts and digests of ids and decoded text."""
    return sentencepiece_bpe.encode_decode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: Language models, inferred automata and a merge agenda have no SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
