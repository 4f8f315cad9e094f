"""Near copies by exact similarity: SimHash and MinHash candidates, each checked on the whole sets.

A document is the set of its shingles of words, as XXH64 hashes. Two documents link when
the Jaccard similarity of their sets is at least a threshold; documents in one connected
component of links are near copies.

Candidates share a cell. The first kind of cell is a component of SimHash fingerprints of the
sets, linked at BITS or fewer differing bits by the anchors of simhash.py. Sets with a similarity
of 0.8 differ in some 10 of 64 bits, too many for any threshold that tells texts apart, so cells of
a second kind find what fingerprints can't: one of BANDS bands, the minima of ROWS random orders of
the sets. A pair at 0.8 misses all bands with a chance of (1 - 0.8^4)^32, 5 in 10^8. Equal sets are
one before that, so copies cost nothing, and cells of the same members are one. Every member
of a cell is compared with the cell's pivot, its smallest digest. What that leaves in one
component needs no more comparing. In the other cells, members that aren't connected with the
pivot are compared with all others, in blocks of a bounded size that are tasks of their own;
a block reports a spanning forest of its links, so pairs are never written out.

Null texts count as empty; texts without words have equal sets. Null identifiers come
after all others; a component of nothing else has a null component_id. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, join_groups, raw, small_enough
from weftline.llm.components import components
from weftline.llm.simhash import THRESHOLD, Forest, keep_first, shingle_hashes, vote
from weftline.llm.simhash import links as simhash_links

WORDS, SIMILARITY = 5, 0.8
BITS = THRESHOLD
BANDS, ROWS = 32, 4
#: Hashes put into random orders at a time, and rows of texts.
HASHES, HELD = 1 << 17, 256
#: Hashes in one side of a block, where every member counts as MEMBER more; columns multiplied at a time.
BLOCK, MEMBER, COLUMNS = 1 << 18, 256, 4096
#: Identifiers of candidates that may go by broadcast.
BROADCAST_IDS = 500_000

_RNG = np.random.default_rng(42)
_FACTORS, _OFFSETS, _FOLDS = (_RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def digest(hashes: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.astype("<u8", copy=False).tobytes())


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """The cells of every set, a signed long for each band; those of an empty set mean nothing."""
    least = np.full((BANDS * ROWS, len(sets)), np.iinfo(np.uint64).max)
    parts = [(k, x[a : a + HASHES]) for k, x in enumerate(sets) for a in range(0, len(x), HASHES)]
    begin, size = 0, 0
    for end in range(1, len(parts) + 1):
        size += len(parts[end - 1][1])
        if end < len(parts) and size + len(parts[end][1]) <= HASHES:
            continue
        owner = np.array([k for k, _ in parts[begin:end]])
        first = np.cumsum([0, *(len(x) for _, x in parts[begin : end - 1])])
        flat = np.concatenate([x for _, x in parts[begin:end]])
        flat = flat ^ (flat >> np.uint64(32))
        for j in range(BANDS * ROWS):
            np.minimum.at(least[j], owner, np.minimum.reduceat(flat * _FACTORS[j] + _OFFSETS[j], first))
        begin, size = end, 0
    mixed = (least ^ (least >> np.uint64(29))) * _FOLDS[:, None]
    mixed ^= mixed >> np.uint64(32)
    number = np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)  # tells bands apart
    return ((mixed * _FACTORS[:, None]).reshape(BANDS, ROWS, -1).sum(axis=1, dtype=np.uint64) ^ number).view(np.int64).T


def _rows(docs: DataFrame, id_col: str, text_col: str, words: int, whole: bool) -> DataFrame:
    """doc_id, digest, and the set itself if whole, its size, fingerprint and bands' cells if not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, HELD):
                part = batch.slice(k, HELD)
                sets = [shingle_set(t.as_py(), words) for t in part.column(1)]
                columns = {"doc_id": part.column(0), "digest": pa.array([digest(s) for s in sets], pa.binary())}
                if whole:
                    columns["hashes"] = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                else:
                    columns |= {"size": pa.array([len(s) for s in sets], pa.int64()), "fp": pa.array(np.array([vote(s) for s in sets], np.uint64).view(np.int64)), "cells": pa.array([c.tolist() if len(s) else [] for s, c in zip(sets, bands(sets))], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = "hashes array<long>" if whole else "size long, fp long, cells array<long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("text")).mapInArrow(run, f"doc_id long, digest binary, {kind}")


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets are similar enough."""
    one, two = (sets.select(F.col("digest").alias(x), F.col("hashes").alias(f"{x}_set")) for x in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(one, "a").join(two, "b").filter(both >= F.lit(similarity) * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def _compare(similarity: float):
    """A block's links between labels, as a spanning forest; rows: cell, i, j, side, digest, label, hashes. A block of one side compares that with itself."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        coded = block.column("label").combine_chunks().dictionary_encode()
        side, label, labels = block.column("side").to_numpy(), coded.indices.to_numpy(), coded.dictionary.to_pylist()
        lists = block.column("hashes").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        code, many = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)[1:]
        row, kept = np.repeat(np.arange(len(size)), size), many[code] > 1  # a hash held once overlaps with nothing
        row, code = row[kept], np.cumsum(many > 1)[code[kept]] - 1
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if (side == 1).any() else one
        both = np.zeros((len(one), len(two)), np.float32)
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
            a, b = np.searchsorted(code, [at, at + COLUMNS])
            held = np.zeros((len(size), COLUMNS), np.float32)
            held[row[a:b], code[a:b] - at] = 1
            both += held[one] @ held[two].T
        near = (both >= np.float32(similarity) * (size[one][:, None] + size[two][None] - both) - 1e-3) & (label[one][:, None] != label[two][None])
        forest, links = Forest(), []
        for x, y in zip(*np.nonzero(near)):
            p, q, n = one[x], two[y], int(both[x, y])
            if n < similarity * (int(size[p]) + int(size[q]) - n):  # in double precision, as everywhere
                continue
            if forest.root(int(label[p])) != forest.root(int(label[q])):
                forest.join(int(label[p]), int(label[q]))
                links.append((labels[label[p]], labels[label[q]]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return run


def simhash_cells(groups: DataFrame) -> DataFrame:
    """digest, size, first_id, cell: the component of its fingerprint, of every set that isn't empty."""
    some = groups.filter("size > 0").select("digest", "size", "first_id", "fp")
    roots = cut(components(simhash_links(cut(some.select("fp").distinct()), BITS)))
    linked = some.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return cut(linked.select("digest", "size", "first_id", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("cell")))


def band_cells(groups: DataFrame) -> DataFrame:
    """digest, size, first_id, cell: one row for each band."""
    return groups.select("digest", "size", "first_id", F.explode("cells").alias("cell"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, component_id."""
    rows = cut(_rows(docs, id_col, text_col, words, False))
    groups = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("cells").alias("cells")))
    held = simhash_cells(groups).unionByName(band_cells(groups))
    cells = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "size")).alias("pivot"), F.sum(F.col("size") + MEMBER).alias("total"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("who")).filter("n > 1")
    cells = cells.groupBy("n", "pivot", "who").agg(F.min("cell").alias("cell"), F.first("total").alias("total"))
    cells = cut(cells.select("cell", "n", F.col("pivot.digest").alias("pivot"), F.col("pivot.size").alias("pivot_size"), "total"))
    members = cut(join_groups(held, cells, ["cell"], "n"))

    wanted = members.select("first_id", "digest").distinct()
    ids = cut(wanted.select("first_id").distinct())
    ids = F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids  # beyond, texts are shuffled once
    some = docs.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col("first_id")), "left_semi")
    sets = _rows(some, id_col, text_col, words, True).join(wanted.select("digest"), "digest", "left_semi")
    sets = cut(sets.groupBy("digest").agg(F.first("hashes").alias("hashes")))

    pairs = members.filter("digest <> pivot").filter(F.least("size", "pivot_size") >= F.lit(similarity) * F.greatest("size", "pivot_size"))
    links = cut(_links(pairs.select(F.col("pivot").alias("a"), F.col("digest").alias("b")).distinct(), sets, similarity))
    roots = cut(components(links).withColumnRenamed("node", "digest"))

    # cells of three and more that more than one component meets in
    labelled = members.filter("n > 2").select("cell", "n", "total", "pivot", "digest").join(roots, "digest", "left").withColumn("label", F.coalesce("root", "digest")).drop("root")
    labelled = cut(labelled)
    several = labelled.groupBy("cell").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max(F.when(F.col("digest") == F.col("pivot"), F.col("label"))).alias("near"), F.count(F.lit(1)).alias("m")).filter("least <> most").select("cell", "near", "m")
    left = join_groups(labelled, cut(several), ["cell"], "m").withColumn("own", F.col("label") == F.col("near"))
    # members connected with the pivot meet the others, and those meet each other too; n blocks to a side
    n = F.ceil(F.col("total") / block).cast("int")
    at = F.pmod(F.xxhash64("digest"), n).cast("int")
    every = F.sequence(F.lit(0), n - 1)
    meets = F.when(F.col("own"), F.transform(every, lambda y: F.struct((-1 - at).alias("i"), y.alias("j"), F.lit(0).alias("side"))))
    meets = meets.otherwise(F.concat(F.transform(every, lambda y: F.struct(F.least(at, y).alias("i"), F.greatest(at, y).alias("j"), (y < at).cast("int").alias("side"))), F.transform(every, lambda y: F.struct((-1 - y).alias("i"), at.alias("j"), F.lit(1).alias("side")))))
    blocks = left.select("cell", "digest", "label", F.explode(meets).alias("b")).select("cell", "b.i", "b.j", "b.side", "digest", "label").join(sets, "digest")
    more = cut(blocks.groupBy("cell", "i", "j").applyInArrow(_compare(similarity), "a binary, b binary"))
    joined = groups.select("digest", "first_id", "n_rows").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    if not more.isEmpty():  # components of the pivots' links that those of blocks bring together
        wider = cut(components(more).select(F.col("node").alias("root"), F.col("root").alias("wider")))
        joined = joined.join(wider, "root", "left").withColumn("root", F.coalesce("wider", "root")).drop("wider")
    ids = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = cut(joined.join(ids, "root").select("digest", "n_rows", "component_id"))
    return join_groups(rows.select("doc_id", "digest"), labels, ["digest"], "n_rows").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each component: that with the smallest identifier.

    Rows without an identifier stay. Of rows repeated with one identifier, one stays.
    """
    return keep_first(docs, cut(near_copies(docs, id_col, text_col, words, similarity)), id_col)
