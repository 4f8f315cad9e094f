"""Packing documents into sequences: first-fit decreasing by a tournament tree.

A document's ids are cut at multiples of the sequence length. Full pieces are
sequences by themselves. What remains of each document is dealt at random (by a hash
of document and piece) into groups of a bounded expected size, and every group is
packed on its own: pieces from the longest to the shortest, each into the first
sequence that still has room. The tournament tree holds the room of every sequence
at its leaves and the larger of two at each node, so the first fitting sequence is
found by walking down once. Groups hold lengths only, never ids.

Given places (the schedule of mixing; see pack_in_order), groups are windows of consecutive pieces in that
order instead, and hold full pieces too. Sequences are numbered by window, and in it by the
earliest place of a piece of theirs, so reading them by number keeps to the schedule up to
a window.

Null texts count as empty: such a document is its end id alone. Bytes that aren't UTF-8 count as U+FFFD. Documents with the same
identifier, or none, are packed each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, partitions, valid_text
from weftline.llm.tokens import default_vocabulary, encoder

SEQUENCE = 4096
END = 2
#: Pieces expected in one randomised group.
GROUP = 16384

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """Rooms of up to n bins; the winner of a match is the larger room, the left one if equal."""

    def __init__(self, n: int, room: int) -> None:
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes the room in the first bin that has it, and says which."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        bin_, at = at - self.leaves, at // 2
        while at:
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
            at //= 2
        return bin_


def first_fit_decreasing(sizes: np.ndarray, room: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset within it of every size, all from 1 to room; ties go by position."""
    order = np.argsort(-sizes, kind="stable")
    tree, filled = Tournament(max(1, len(sizes)), room), {}
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k in order.tolist():
        size = int(sizes[k])
        b = tree.place(size)
        offsets[k] = filled.get(b, 0)
        filled[b] = offsets[k] + size
        bins[k] = b
    return bins, offsets


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, room: int = SEQUENCE, end: int = END, source_col: str | None = None) -> DataFrame:
    """Every document's pieces, no longer than room, in its own order; with its source if source_col is given."""
    named = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, last = encoder(vocabulary), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            sources: list[str] = []
            names = batch.column(2).to_pylist() if source_col else [""] * batch.num_rows
            for doc, ids, name in zip(batch.column(0).to_pylist(), code.encode(batch.column(1)), names):
                n = len(ids) + 1
                data = ids.astype("<u4", copy=False).tobytes() + last
                rows += [(doc, a, min(room, n - a), zlib.crc32(data[4 * a : 4 * (a + room)]), n) for a in range(0, n, room)]
                sources += [name] * (len(rows) - len(sources))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)]
            if source_col:
                columns.append(pa.array(sources, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*named, "source"] if source_col else named)

    chosen = [F.col(id_col).cast("long").alias("doc_id"), valid_text(text_col).alias("text")]
    if source_col:
        chosen.append(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    return docs.select(*chosen).mapInArrow(run, PIECE + (", source string" if source_col else ""))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, room: int = SEQUENCE, end: int = END, group_size: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cuts = cut(pieces(docs, id_col, text_col, vocabulary or default_vocabulary(), room, end).withColumn("row", F.monotonically_increasing_id()))
    whole = F.col("length") == room
    rest = cuts.filter(~whole)
    groups = max(1, -(-rest.count() // group_size))
    rest = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(groups)))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), room)
        out = group.assign(bin=bins, offset=offsets)
        # sequences of remainders have odd ids, full ones even ids
        out["sequence_id"] = 2 * ((int(key[0]) << 32) + out.pop("bin")) + 1
        return out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    packed = rest.groupBy("group").applyInPandas(run, PIECE + ", sequence_id long, offset long")
    full = cuts.filter(whole).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)


def pack_in_order(docs: DataFrame, places: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str | None = None, room: int = SEQUENCE, end: int = END, window: int = GROUP) -> DataFrame:
    """Like pack(), in windows of the order of places: doc_id, source, position, one row for each that docs has."""
    spark = docs.sparkSession
    cuts = pieces(docs, id_col, text_col, vocabulary or default_vocabulary(), room, end, source_col).withColumn("row", F.monotonically_increasing_id())
    at = places.select(F.col("doc_id").alias("at_id"), F.col("source").alias("at_source"), "position")
    placed = cuts.join(at, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("source") == F.col("at_source"))).drop("at_id", "at_source", "source")
    order = ["position", "doc_id", "row", "start"]
    placed = placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed)
    part, first = F.shiftright("at", 33), F.min(F.col("at"))
    runs = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), first.alias("first")).orderBy("part").collect()  # a row for each partition
    starts, before = [(-1, 0, 0)], 0
    for r in runs:
        starts.append((r["part"], r["first"], before))
        before += r["n"]
    begin = F.broadcast(spark.createDataFrame(starts, "part long, first long, before long"))
    ranked = placed.withColumn("part", part).join(begin, "part").withColumn("rank", F.col("at") - F.col("first") + F.col("before"))
    ranked = ranked.withColumn("group", F.floor(F.col("rank") / window))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), room)
        number = {b: k for k, b in enumerate(dict.fromkeys(bins.tolist()))}  # by the first piece of each
        out = group.assign(offset=offsets)
        out["sequence_id"] = (int(key[0]) << 32) + np.array([number[b] for b in bins.tolist()], np.int64)
        return out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "group").groupBy("group").applyInPandas(run, PIECE + ", sequence_id long, offset long")
