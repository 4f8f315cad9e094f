"""A training-data pipeline over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import line_dedup as _lines
from weftline.llm import mixing as _mixing
from weftline.llm import near_dedup as _near
from weftline.llm import packing as _packing
from weftline.llm import toxicity as _toxicity
from weftline.llm.common import scratch, table

#: Near copies: shingles of five words, a Jaccard similarity of 0.8 or more.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    return _toxicity.drop_toxic(docs, _toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too large a share of a source's documents, and on two at least, go; every document stays."""
    return _lines.drop_boilerplate(docs, "source", "text", length_col="n_chars")


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: candidates by SimHash, and by MinHash what 64 bits can't find, checked on whole sets."""
    return _near.drop_near_copies(docs, words=NEAR_WORDS, similarity=NEAR_SIMILARITY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves sources by weight."""
    return _mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, which follow the order of mixing by number.

    Parquet doesn't keep the order of partitions, so the places are worked out again, from the same documents.
    """
    return _packing.pack_in_order(docs, _mixing.schedule(docs))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash), ("mixing", mixing), ("packing", packing)]

#: The classifier's fit, fingerprints and first-fit packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, name))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
