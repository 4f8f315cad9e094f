"""The corpus queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from weftline.llm import ann as _ann
from weftline.llm import exact_dedup as _exact
from weftline.llm import line_dedup as _lines
from weftline.llm import mixing as _mixing
from weftline.llm import packing as _packing
from weftline.llm import simhash as _simhash
from weftline.llm import suffix_dedup as _suffixes
from weftline.llm import token_files as _tokens
from weftline.llm import toxicity as _toxicity
from weftline.llm import warc as _warc
from weftline.llm.common import table


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _toxicity.score(docs, _toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_toxicity": toxicity,
    "op2_exact_dedup": lambda spark, d: _exact.exact_dedup(table(spark, d, "documents")),
    "op3_mixing": lambda spark, d: _mixing.schedule(table(spark, d, "documents")),
    "op4_simhash": lambda spark, d: _simhash.near_duplicates(table(spark, d, "documents")),
    "op5_packing": lambda spark, d: _packing.pack(table(spark, d, "documents")),
    "op6_token_files": lambda spark, d: _tokens.round_trip(table(spark, d, "documents")),
    "op7_line_dedup": lambda spark, d: _lines.report(table(spark, d, "documents")),
    "op8_warc": lambda spark, d: _warc.round_trip(table(spark, d, "pages")),
    "op9_ann": lambda spark, d: _ann.search(table(spark, d, "embeddings")),
    "op10_suffix_dedup": lambda spark, d: _suffixes.report(table(spark, d, "documents")),
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_exact_dedup": _exact.ORACLE,
    "op7_line_dedup": _lines.ORACLE,
    "op8_warc": _warc.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
