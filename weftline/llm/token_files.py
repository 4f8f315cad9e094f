"""Token ids as Parquet list columns.

One row per document in ascending order of its identifier: the identifier, its number
of ids and the list of ids. Lists are dictionary-encoded (a vocabulary's ids fit the
dictionary page, so an id takes as many bits as the vocabulary needs), row groups are
kept to a fixed size, and the writer adds column and offset indexes, so a reader of a
few documents or of the lengths alone fetches the pages it needs.

Null texts count as empty: such a document is its end id alone. Bytes that aren't UTF-8 count as U+FFFD. Null identifiers come
first. Documents with the same identifier follow each other, in any order, each in a row
of its own. An empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import partitions, scratch, settings, valid_text
from weftline.llm.tokens import default_vocabulary, encoder

END = 1
ROW_GROUP = 32 << 20
PAGE = 256 << 10
FILE = "doc_id long, n_tokens int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END) -> None:
    """Encodes every whole text and writes the files; part names ascend with the identifiers."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, last = encoder(vocabulary), np.array([end], np.uint32)
        for batch in batches:
            lists = [np.concatenate((ids, last)) for ids in code.encode(batch.column(1))]
            size = np.fromiter(map(len, lists), np.int32, len(lists))
            values = pa.array(np.concatenate(lists).view(np.int32) if lists else np.empty(0, np.int32))
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "n_tokens", "ids"])

    spark = docs.sparkSession
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), valid_text(text_col).alias("text"))
    ordered = ordered.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    # few texts at a time on their way to Python: a batch is bounded by rows, and texts can be long
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000"):
        (ordered.mapInArrow(run, FILE).write.option("compression", "zstd").option("parquet.enable.dictionary", "true")
         .option("parquet.block.size", str(ROW_GROUP)).option("parquet.page.size", str(PAGE)).parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(path)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, one row per document: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(np.ascontiguousarray(ids[a:b], "<u4")) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "row", "doc_id", "n_tokens", "ids_crc32"])

    files = read_tokens(spark, path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "ids")
    rows = files.mapInArrow(run, "file string, row long, doc_id long, n_tokens long, ids_crc32 long")
    # the lengths alone, from their own column, give each file's place; there are as many rows as files
    sums = read_tokens(spark, path).select(F.col("_metadata.file_name").alias("file"), "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")  # names have five digits or more, so they don't sort by themselves
    places = sums.select("file", (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(F.broadcast(places), "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    write_tokens(docs, path := scratch(spark, "tokens"))
    return digest(spark, path)
