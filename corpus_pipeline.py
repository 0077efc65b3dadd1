"""Corpus pipeline: stages over the documents table, each written as Parquet and reread.

toxicity rejects documents, near-dedup keeps one document of each group, personal data
is replaced in the texts, sources are mixed to their target weights (rows repeat as
often as the mix takes them), and what remains is encoded to SentencePiece ids.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty
tables, as its operator states: a null or empty text is never toxic, a group of its own,
without personal data and never taken by the mix; rows that repeat a doc_id are one
document to near-dedup; rows without a doc_id are kept by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthmill.llm import mixing, near_dedup, pieces, pii, toxicity
from monthmill.llm.common import stage, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says clean; the lexicon is learned from the labels of these documents."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of five-word-shingle near copies."""
    return near_dedup.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; spans become their kind in angle brackets, and n_chars follows."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times."""
    return mixing.repeat_by_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids of each remaining row; a document that the mix repeats stands in as many rows."""
    return pieces.encode_pieces(docs.select("doc_id", "lang", "source", "text"), pieces.model_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: SQL can't express the stages' learned scores and sketches; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        # A stage's table goes once the next one is written.
        docs = stage(function(spark, docs, sf_dir), f"stage-{name}", drop=[docs])
    return docs
