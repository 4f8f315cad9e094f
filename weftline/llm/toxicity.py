"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of the lower-cased text, hashed; a document has a feature or
hasn't. A feature's ratio is r = log of its share among toxic documents over its share among
the others, smoothed; the classifier is logistic regression on features of value r. Only
the features that tell the classes apart best keep a weight.

It is fitted on a bounded sample of labelled rows (POSITIVES and NEGATIVES, by hash of the
identifier), never on held-out ones, whose crc32 of the identifier as text leaves 1 when
divided by 3. Every document is scored on its whole text.

Null texts count as empty; empty texts score by the intercept alone. Bytes that aren't UTF-8 count as U+FFFD.
Long texts are read in overlapping windows, so memory doesn't follow the longest text's n-grams. Null identifiers are
neither labelled nor held out. Of several labels for one identifier the highest counts; null
labels don't. Without labels of both kinds every document scores the share of toxic ones, one
half if there are none. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, free_name, valid_text

ORDERS = (3, 4, 5, 6)
BITS = 20
#: Rows fitted on at most, and features that keep a weight.
POSITIVES, NEGATIVES, KEPT = 4000, 8000, 4096
LEAST_DOCUMENTS = 4
SMOOTHING = 1.0
PENALTY = 3e-4
STEPS = 300
THRESHOLD = 0.7
#: Partitions that the sample is counted in, rows held as Python strings and characters hashed at a time.
COUNTERS, HELD, AT_ONCE = 8, 256, 1 << 18

_MIX = np.uint32(0x9E3779B1)
_BASE = np.uint32(0x01000193)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the row and the bucket of every n-gram; none crosses from row to row."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes <= 32, np.uint32(32), codes)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters from here to the row's end
    hashed = codes.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            return
        hashed = hashed[: len(codes) - n + 1] * _BASE + codes[n - 1 :]
        if n in ORDERS:
            bucket = ((hashed ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * _MIX) >> np.uint32(32 - BITS)
            inside = left[: len(bucket)] >= n
            yield row[: len(bucket)][inside], bucket[inside]


def windows(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Lower-cased texts, some AT_ONCE characters at a time, and the row of each; a longer one in windows that share their ends."""
    rows, held, size, overlap = [], [], 0, max(ORDERS) - 1
    for row, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, max(1, len(text) - overlap), AT_ONCE):
            held.append(text[at : at + AT_ONCE + overlap])
            rows.append(row)
            size += len(held[-1])
            if size >= AT_ONCE:
                yield np.array(rows), held
                rows, held, size = [], [], 0
    if held:
        yield np.array(rows), held


def marked_pairs(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs, by row, of the buckets that the table marks."""
    found = [np.empty(0, np.int64)]
    for rows, some in windows(texts):
        for row, bucket in grams(some):
            at = np.flatnonzero(table[bucket])
            found.append(np.unique((rows[row[at]] << BITS) | bucket[at]))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


class Presence:
    """Each text's distinct buckets, without sorting."""

    def __init__(self) -> None:
        self.seen, self.last = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int32)

    def of(self, text: str | None) -> np.ndarray:
        out = [np.empty(0, np.uint32)]
        for _, some in windows([text]):
            for _, bucket in grams(some):
                bucket = bucket[~self.seen[bucket]]
                at = np.arange(len(bucket), dtype=np.int32)
                self.last[bucket] = at
                new = bucket[self.last[bucket] == at]
                self.seen[new] = True
                out.append(new)
        found = np.concatenate(out)
        self.seen[found] = False
        return found


def held_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, HELD):
            yield batch.slice(k, HELD)


def fit(rows: np.ndarray, features: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features (on values of ratio) and intercept: penalised logistic loss by accelerated gradient.

    The sample and the kept features are bounded, and so is the dense matrix: 200 MB at most.
    """
    n, k = len(y), len(ratio)
    x = np.zeros((n, k), np.float32)
    x[rows, features] = ratio[features]
    # the rarer class counts more, by the root of the ratio: between the sample's own shares and equal ones
    each = np.where(y > 0, np.sqrt((1 - y.mean()) / y.mean()), 1.0)
    each = (each / each.sum()).astype(np.float32)
    v = np.random.default_rng(0).standard_normal(k).astype(np.float32)
    for _ in range(12):
        v = (each * (x @ (v / np.linalg.norm(v)))) @ x
    rate = float(1 / (0.25 * (1.1 * np.linalg.norm(v) + 1) + PENALTY))
    share = float((each * y).sum())
    w, b = np.zeros(k, np.float32), float(np.log(share / (1 - share)))
    pw, pb = w, b
    for step in range(STEPS):
        m = step / (step + 3)
        qw, qb = w + np.float32(m) * (w - pw), b + m * (b - pb)
        g = (each * (1 / (1 + np.exp(-np.clip(x @ qw + qb, -50, 50))) - y)).astype(np.float32)
        pw, pb = w, b
        w, b = qw - np.float32(rate) * (g @ x + np.float32(PENALTY) * qw), qb - rate * float(g.sum())
    return w.astype(float), float(b)


class Model:
    """A weight for each of some buckets, and an intercept: some KEPT numbers, which a task spreads out into tables."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray, intercept: float) -> None:
        self.buckets, self.values, self.intercept = buckets, values, intercept

    @cached_property
    def weights(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.buckets] = self.values
        return out

    @cached_property
    def marked(self) -> np.ndarray:
        return self.weights != 0

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("buckets", "values", "intercept")}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        row, bucket = marked_pairs(texts, self.marked)
        out = self.intercept + np.bincount(row, weights=self.weights[bucket].astype(np.float64), minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null").filter(~held_out("id"))
    known = known.groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    order = F.xxhash64("id")
    sample = known.filter("y = 1").orderBy(order, "id").limit(POSITIVES).unionAll(known.filter("y = 0").orderBy(order, "id").limit(NEGATIVES))
    texts = docs.select(F.col(id_col).alias("id"), valid_text(text_col).alias("text")).join(F.broadcast(sample), "id").select("y", "text")
    texts = cut(texts.repartition(COUNTERS))  # of the bounded sample alone; the scan keeps its own tasks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, present = np.zeros((2, 1 << BITS), np.uint32), np.zeros(2, np.int64), Presence()
        for batch in held_rows(batches):
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[y] += 1
                seen[y][present.of(text)] += 1
        out = [pa.array([int(x)], pa.int64()) for x in total] + [pa.array([x.tobytes()], pa.binary()) for x in seen]
        yield pa.RecordBatch.from_arrays(out, names=["n0", "n1", "c0", "c1"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers of rows, the buckets that tell the classes apart best, and their ratios."""
        n, seen = np.zeros(2, np.int64), np.zeros((2, 1 << BITS))
        for batch in batches:
            for r in batch.to_pylist():
                n += (r["n0"], r["n1"])
                seen += [np.frombuffer(r["c0"], np.uint32), np.frombuffer(r["c1"], np.uint32)]
        kept = scale = np.empty(0)
        if n.all():
            p, q = (seen[1] + SMOOTHING) / (n[1] + 2 * SMOOTHING), (seen[0] + SMOOTHING) / (n[0] + 2 * SMOOTHING)
            pooled = seen.sum(axis=0) / n.sum()
            apart = (seen[1] / n[1] - seen[0] / n[0]) ** 2 / np.maximum(pooled * (1 - pooled), 1e-12)  # a two-sample statistic, up to a constant
            apart[seen.sum(axis=0) < min(LEAST_DOCUMENTS, n[1])] = 0
            kept = np.sort(np.argsort(-apart, kind="stable")[:KEPT])
            kept = kept[apart[kept] > 0]
            scale = np.log(p / q)[kept]
        columns = [pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([kept.tolist()], pa.list_(pa.int32())), pa.array([scale.tolist()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["n", "kept", "scale"])

    # COUNTERS rows of 8 MB meet in one task; the driver gets KEPT numbers
    chosen = texts.mapInArrow(count, "n0 long, n1 long, c0 binary, c1 binary").repartition(1).mapInArrow(choose, "n array<long>, kept array<int>, scale array<double>").first()
    n, kept, scale = (np.array(chosen[k]) for k in ("n", "kept", "scale"))
    if not n.all() or not len(kept):
        share = min(max((n[1] + 0.5) / (n.sum() + 1), 1e-6), 1 - 1e-6)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(1 << BITS, -1, np.int32)
        slot[kept] = np.arange(len(kept))
        for batch in held_rows(batches):
            row, bucket = marked_pairs(batch.column(1).to_pylist(), slot >= 0)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(slot[bucket]))], names=["y", "has"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, rows, features, n_rows = [], [], [], 0
        for batch in batches:
            has = batch.column(1)
            ends = has.offsets.to_numpy()
            ys.append(batch.column(0).to_numpy())
            rows.append(n_rows + np.repeat(np.arange(len(has), dtype=np.int32), np.diff(ends)))
            features.append(has.flatten().to_numpy())
            n_rows += len(has)
        if n_rows:
            w, b = fit(np.concatenate(rows), np.concatenate(features), np.concatenate(ys).astype(float), scale)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], names=["w", "b"])

    # the bounded sample's kept features meet in one task, on an executor
    got = texts.mapInArrow(select, "y int, has array<int>").repartition(1).mapInArrow(learn, "w binary, b double").first()
    return Model(kept, np.frombuffer(got["w"]) * scale, got["b"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held_rows(batches):
            s = model.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), valid_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more."""
    (mark,) = free_name(docs, "scored_text")
    last = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held_rows(batches):
            stays = model.scores(batch.column(last).to_pylist()) < threshold
            yield pa.RecordBatch.from_arrays(batch.columns[:last], names=batch.schema.names[:last]).filter(pa.array(stays))

    return docs.withColumn(mark, valid_text(text_col)).mapInArrow(run, docs.schema)
