"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, so that a stage can be run on what the one
before has written. ``run`` writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, common, exact_dedup, langid, minhash, mixing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a known language explains better than the plain code of their bytes stay.

    Null texts and texts without a letter go; without any labelled text all go;
    repeated rows are judged each; an empty table stays one.
    """
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts that are equal without blanks the one with most code points stays, then the least id.

    Null and empty texts are one class; of repeated rows one stays; null ids come last.
    """
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of near-duplicates stays.

    Texts without words are linked with nothing and stay; of repeated rows one stays.
    """
    return minhash.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight gives it, in the order of blocks.

    Texts without words are never taken; a null source is the source ``''``.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of each document that was taken, as often as it was taken.

    A null text has no tokens.
    """
    rows = docs.select("doc_id", "source", "text")
    return bpe.with_ids(rows, "text").selectExpr("doc_id", "source", "size(ids) AS n_tokens", "ids")


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing to target weights", mix),
    ("BPE encoding", tokens),
]

#: Language ID, near-dedup and BPE are no SQL; the tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
