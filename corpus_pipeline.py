"""Corpus pipeline: quality classifier, exact dedup, MinHash near-dedup, benchmark decontamination, BPE.

Each stage works on all rows that its predecessor kept and returns the columns of documents; the last one returns
the ids of every document that is left, as its tokens' count and digests.

Every stage takes an empty table (and returns one), nulls in any column, texts of any length, and further columns of
whatever name, which it keeps as they are. A null or empty text is a text without words: it is scored like others, all
such rows are copies of one another for exact dedup, and none is a near-duplicate or holds an item. What a stage does
with null ids, ties and repeated rows is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewright.llm import bpe, decontaminate, exact_dedup, near_dedup, quality, queries
from casewright.llm.common import materialise, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go; a row is judged by its text alone, so repeated rows go or stay together."""
    return quality.keep_good(docs, queries.quality_network(spark, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; a null id ranks below all others, and of wholly repeated rows one stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8), the document with the smallest doc_id stays.

    A null id ranks after all others; rows that share the group's smallest id all stay.
    """
    return near_dedup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, row by row, whatever their ids."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, null ids and repeated rows included."""
    return bpe.encode_documents(docs, queries.WORD_BPE, whole=False)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: A trained network and a tokenizer can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
