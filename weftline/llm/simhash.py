"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has 64 bits, voted by the XXH64 hashes of its shingles of
words. Fingerprints that differ in few bits link; documents in one connected component
of links are near copies.

The bits are split into blocks: of two linked fingerprints, some block differs in no more
than its share of the threshold. In a block, the anchors are the words of a covering code,
a Hamming code on as many bits as it can take and all words on the others: every value is
within one bit of an anchor, its home. A fingerprint is replicated to every anchor within
that covering radius plus the block's share of the threshold, so it meets, at the other's
home, each fingerprint that it links with. Anchors compare their homes with all that came.

Equal fingerprints are one before that, so copies cost nothing, and each partition reports
a spanning forest of the links that it finds, never all pairs. An anchor with many homes, as a large
family of near copies makes them, is dealt into squares of some HOMES homes and as many shares of what
comes to it.

Null texts count as empty; a text without words has fingerprint zero and links like any
other. Null identifiers come after all others; a component of nothing else has a null
component_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, join_groups, partitions, raw, small_enough, without
from weftline.llm.components import components

WORDS = 4
SEED = 42
THRESHOLD = 4
#: Blocks that the bits are split into. Three give 2^17 anchors a block or more and 44 replicas;
#: two give 2^27 anchors and 342 replicas, for more distinct fingerprints than MANY.
BLOCKS, MANY = 3, 1 << 28
#: Homes of an anchor compared in one task.
HOMES = 4096
#: Rows of the table of larger anchors that may go by broadcast.
BROADCAST_ANCHORS = 200_000
#: Shingles voted at a time.
VOTES = 1 << 16


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words)))) if len(found) >= words else [b" ".join(found)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64)


def vote(hashes: np.ndarray) -> int:
    """The fingerprint: each bit that is set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), VOTES):
        part = hashes[k : k + VOTES].astype("<u8", copy=False)
        for bit in range(8):
            lanes = ((part >> np.uint64(bit)) & np.uint64(0x0101010101010101)).view(np.uint8).reshape(-1, 8)
            count[bit::8] += lanes.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((vote(shingle_hashes(t.as_py(), words)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Covering:
    """The anchors of one block: shift and width say where its bits are."""

    def __init__(self, number: int, shift: int, width: int, share: int) -> None:
        self.number, self.shift, self.width = number, shift, width
        checks = (width + 1).bit_length() - 1
        self.coded = (1 << checks) - 1  # bits that the Hamming code takes; each value is within one bit of a word
        masks: dict[int, list[int]] = {s: [] for s in range(self.coded + 1)}
        for weight in range(share + 2):  # covering radius 1 plus the block's share
            for bits in combinations(range(width), weight):
                syndrome = 0
                for b in bits:
                    syndrome ^= b + 1 if b < self.coded else 0
                masks[syndrome].append(sum(1 << b for b in bits))
        size = np.array([len(masks[s]) for s in sorted(masks)])
        self.flat, self.size = np.array([m for s in sorted(masks) for m in masks[s]], np.uint64), size
        self.first = np.concatenate(([0], np.cumsum(size)[:-1]))

    def home(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each fingerprint's bits in this block, their syndrome, and the anchor that they belong to."""
        value = (fps >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)
        syndrome = np.zeros(len(fps), np.uint64)
        for b in range(self.coded):
            syndrome ^= ((value >> np.uint64(b)) & np.uint64(1)) * np.uint64(b + 1)
        return value, syndrome, np.where(syndrome > 0, value ^ (np.uint64(1) << (np.maximum(syndrome, 1) - np.uint64(1))), value)

    def cell(self, anchor: np.ndarray) -> np.ndarray:
        return (np.uint64(self.number) << np.uint64(58)) | anchor

    def replicas(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each meeting of a fingerprint and an anchor: its index, the anchor's cell, whether it is the home."""
        value, syndrome, home = self.home(fps)
        s = syndrome.astype(np.int64)
        many = self.size[s]
        at = np.repeat(np.arange(len(fps)), many)
        within = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        anchor = value[at] ^ self.flat[self.first[s][at] + within]
        return at, self.cell(anchor), anchor == home[at]


def coverings(blocks: int, threshold: int) -> list[Covering]:
    out, shift = [], 0
    for k in range(blocks):
        width = (64 - shift) // (blocks - k)
        out.append(Covering(k, shift, width, threshold // blocks))
        shift += width
    return out


class Forest:
    """Union-find over fingerprints; remembers only those that link."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def compare(fps: np.ndarray, home: np.ndarray, threshold: int, forest: Forest) -> None:
    """All links between the homes of one anchor and whatever came to it."""
    if len(fps) < 2:
        return
    for f in fps[home]:
        near = fps[np.bitwise_count(fps ^ f) <= threshold]
        if len(near) > 1:
            x = int(f)
            for y in near.tolist():
                if y != x:
                    forest.join(x, y)


def links(distinct: DataFrame, threshold: int = THRESHOLD, blocks: int = BLOCKS, homes: int = HOMES) -> DataFrame:
    """Edges a, b over distinct fingerprints (column fp) that connect what the links connect."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = coverings(blocks, threshold)
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(every), 4096):
                fps = every[k : k + 4096]
                for code in codes:
                    at, cell, home = code.replicas(fps)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fps[at].view(np.int64)), pa.array(home)], names=["cell", "fp", "home"])

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = coverings(blocks, threshold)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c.cell(c.home(fps)[2]) for c in codes]).view(np.int64))], names=["cell"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept = Forest(), [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)]

        def cells(cell: np.ndarray, fps: np.ndarray, home: np.ndarray) -> None:
            edges = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
            busy = np.add.reduceat(home, edges[:-1], dtype=np.int64) > 0 if len(cell) else np.empty(0, bool)
            for a, b in zip(edges[:-1][busy].tolist(), edges[1:][busy].tolist()):
                compare(fps[a:b], home[a:b], threshold, forest)

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            cell, fps, home = (np.concatenate(x) for x in zip(kept, new))
            last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            cells(cell[:last], fps[:last], home[:last])
            kept = [cell[last:], fps[last:], home[last:]]
        if len(kept[0]):
            cells(*kept)
        nodes = list(forest.up)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in (nodes, [forest.root(x) for x in nodes])], names=["a", "b"])

    n = partitions(distinct.sparkSession)
    spread = distinct.select("fp").repartition(n)  # few rows become many here
    met = spread.mapInArrow(replicate, "cell long, fp long, home boolean")
    large = distinct.select("fp").mapInArrow(at_home, "cell long").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > homes)
    large = cut(large.select("cell", F.ceil(F.col("n") / homes).cast("int").alias("side")))
    if not large.isEmpty():
        tagged = met.join(F.broadcast(large) if small_enough(large, BROADCAST_ANCHORS) else large, "cell", "left")
        at = F.pmod(F.xxhash64("fp"), F.col("side")).cast("int")
        every = F.sequence(F.lit(0), F.col("side") - 1)
        # as a home in row `at` of the squares, as what came in column `at`
        squares = F.transform(every, lambda k: F.struct(at.alias("i"), k.alias("j"), F.lit(True).alias("home")))
        columns = F.transform(every, lambda k: F.struct(k.alias("i"), at.alias("j"), F.lit(False).alias("home")))
        places = F.when(F.col("home"), F.concat(squares, F.filter(columns, lambda x: x["i"] != at))).otherwise(columns)
        split = tagged.filter("side is not null").select("cell", "fp", F.explode(places).alias("p"))
        # fingerprints link by themselves, so a chance meeting of two squares does no harm
        split = split.select(F.xxhash64("cell", "p.i", "p.j").alias("cell"), "fp", F.col("p.home").alias("home"))
        met = tagged.filter("side is null").select("cell", "fp", "home").unionByName(split)
    return met.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, blocks: int | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id."""
    rows = cut(fingerprints(docs, id_col, text_col, words))
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")))
    if blocks is None:
        blocks = BLOCKS if groups.count() <= MANY else 2
    roots = cut(components(links(groups, threshold, blocks)))
    linked = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = cut(linked.join(ids, "root").select("fp", "n_rows", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_groups(rows, labels, ["fp"], "n_rows").select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = THRESHOLD, blocks: int | None = None) -> DataFrame:
    """docs with one document of each component: that with the smallest identifier.

    Rows without an identifier stay. Of rows repeated with one identifier, one stays.
    """
    return keep_first(docs, cut(near_duplicates(docs, id_col, text_col, words, threshold, blocks)), id_col)


def keep_first(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """docs with one document of each component of labels (doc_id, component_id), and all without an identifier."""
    kept = without(docs, labels.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct(), id_col)
    again = cut(labels.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias(id_col)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(id_col))
    if again.isEmpty():
        return kept
    return without(kept, again, id_col).unionByName(kept.join(again, id_col, "left_semi").dropDuplicates([id_col]))
