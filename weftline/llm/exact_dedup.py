"""Exact duplicates by a tree-merge of sorted digest runs.

Each input partition forms one run: its digests, sorted, each with the smallest
identifier and the number of rows seen. Runs meet in binomial rounds: in the
round for some bits of the run number, the runs that differ in those bits alone
exchange rows so that each keeps the digests whose own bits match, and merges
what it gets in the order of digests. After the last round a digest has met all its equals. Every
level's rows carry the text's length and a second hash beside the SHA-256, and
only rows equal in all three merge, so what is retained is verified throughout.

No round moves texts, and a run has a digest at most once, so a text held by a
third of all rows costs one row per run.

Null texts count as empty. Null identifiers come after all others; a group of
nothing else has a null keep_id and its rows are not kept. Rows repeated with the
same identifier are indistinguishable and share one answer. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, join_groups, partitions

#: Bits of the run number settled in one round: four runs merge at a time.
ROUND_BITS = 2

_KEY = ["digest", "n_bytes", "second"]


def normalised(text: str) -> F.Column:
    """Runs of ASCII white space as one space; a lone space is left alone, which is the same and cheaper."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("t"))
    return text.select("doc_id", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("second"))


def merged_runs(rows: DataFrame) -> DataFrame:
    """One row per distinct text: digest, smallest identifier, number of rows."""
    rounds = 1
    while 1 << (ROUND_BITS * rounds) < partitions(rows.sparkSession):
        rounds += 1
    runs = 1 << (ROUND_BITS * rounds)
    home = F.pmod(F.xxhash64("digest"), F.lit(runs)).cast("int")
    run = rows.select(F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"), *_KEY, "doc_id")
    level = run.groupBy("run", *_KEY).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    for k in range(rounds):
        mask = (1 << (ROUND_BITS * (k + 1))) - (1 << (ROUND_BITS * k))
        sent = F.col("run").bitwiseAND(F.lit(~mask)).bitwiseOR(home.bitwiseAND(F.lit(mask)))
        level = merge(level.withColumn("run", sent).repartitionById(runs, "run"))
    return cut(level.drop("run"))


def merge(level: DataFrame) -> DataFrame:
    """Runs that lie in one partition, merged in the order of digests: equals meet there, at most one from each.

    The planner sorts by the window's keys and streams over them; the first of equals has the smallest identifier.
    """
    equals = Window.partitionBy("run", *_KEY)
    place = F.row_number().over(equals.orderBy(F.col("keep_id").asc_nulls_last()))
    return level.withColumn("place", place).withColumn("group_size", F.sum("group_size").over(equals)).filter("place = 1").drop("place")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(digests(docs, id_col, text_col))
    groups = merged_runs(rows)
    both = join_groups(rows, groups, _KEY, "group_size")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return both.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) as kept, text_sha256 from t join g using (text_sha256)
"""
