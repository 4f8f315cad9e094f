"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample, split by k-means into BRANCHES parts again and again
until a part stands for LEAF vectors. Every vector goes to the leaf that it reaches by the
nearest centre at each level. A query walks the tree through a priority queue of centres by
distance and so meets the leaves best first; how many it visits is calibrated: vectors of a
bounded sample, none of them a query, are answered exactly, against all vectors, and the visits are
widened until the mean share of true neighbours found reaches the wanted recall. A query goes on
until the leaves that it has met hold as many vectors as it wants.

Neighbouring leaves are compared with their queries in one task, up to CHUNK vectors; a leaf with
more, a vector that a third of all rows hold for one, is dealt into chunks. A task reports its
nearest few for each query, so pairs are never written out.

Vectors that are null, zero, of another length than most, or that hold null or non-finite
numbers take no part. Null identifiers take no part either. Rows repeated with one identifier
and vector are one candidate. With fewer candidates than wanted, all are returned. An empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut

#: Rows that the tree is fitted on at most, parts that a part is split into, vectors that a leaf stands for.
SAMPLE, BRANCHES, LEAF, ROUNDS = 32768, 16, 200, 8
#: Vectors that the visits are calibrated on, and the mean recall they must reach.
CALIBRATION, RECALL = 128, 0.97
#: Vectors of a leaf compared in one task.
CHUNK = 8192


def take_part(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vec (array<double>) of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).filter("vec_id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = cut(rows.filter(F.size("vec") == (sizes[0]["d"] if sizes else 0)))
    twice = cut(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id"))
    if twice.isEmpty():
        return rows
    # only rows of identifiers that occur again need comparing
    return rows.join(twice, "vec_id", "left_anti").unionByName(rows.join(twice, "vec_id", "left_semi").distinct())


def vectors(column: pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1) if len(column) else np.empty((0, 0)))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances for choosing centres; what is reported is computed by nearest()."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and each row's centre; fewer than k if rows coincide."""
    centres = np.unique(x, axis=0) if len(x) <= 4 * k else x[rng.choice(len(x), k, replace=False)]
    centres = centres[rng.permutation(len(centres))[:k]] if len(centres) > k else centres
    for _ in range(ROUNDS):
        at = squared(x, centres).argmin(1)
        many = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = (sums / np.maximum(many, 1)[:, None])[many > 0]
    return centres, squared(x, centres).argmin(1)


class Tree:
    """Nodes in the order made; kids[n] lists a node's children, centres[n] their centres. Leaves have none."""

    def __init__(self, x: np.ndarray, part: int) -> None:
        rng = np.random.default_rng(0)
        self.kids: list[list[int]] = [[]]
        self.centres: list[np.ndarray | None] = [None]
        todo = [(0, x)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= part:
                continue
            centres, at = k_means(rows, max(2, min(BRANCHES, -(-len(rows) // part))), rng)
            if len(centres) < 2:
                continue
            self.centres[node] = centres
            for k in range(len(centres)):
                self.kids[node].append(len(self.kids))
                todo.append((len(self.kids), rows[at == k]))
                self.kids.append([])
                self.centres.append(None)
        self.leaves = sum(not k for k in self.kids)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.kids[node] or not len(rows):
                out[rows] = node
                continue
            at = squared(x[rows], self.centres[node]).argmin(1)
            todo += [(kid, rows[at == k]) for k, kid in enumerate(self.kids[node])]
        return out

    def in_order(self) -> Iterator[int]:
        """Leaves, those of one branch together."""
        todo = [0]
        while todo:
            node = todo.pop()
            if not self.kids[node]:
                yield node
            todo += self.kids[node]

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves by a priority queue of the distances to their centres."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.kids[node]:
                yield node
                continue
            for d, kid in zip(((self.centres[node] - q) ** 2).sum(1).tolist(), self.kids[node]):
                heapq.heappush(queue, (d, kid))


def buckets(tree: Tree, counts: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """(bucket of each leaf, chunks of each bucket): neighbouring leaves share a bucket up to CHUNK vectors.

    A leaf of more has a bucket of its own, dealt into chunks.
    """
    of, chunks, bucket, size = {}, {0: 1}, 0, 0
    for leaf in tree.in_order():
        n = counts.get(leaf, 0)
        if size and size + n > CHUNK:
            bucket, size = bucket + 1, 0
        of[leaf], size = bucket, size + n
        chunks[bucket] = -(-size // CHUNK) or 1
    return of, chunks


def nearest(q: np.ndarray, ids: np.ndarray, x: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of the k nearest rows of x, ties to smaller ids; own takes no part."""
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    d[ids == own] = np.inf
    if len(d) > k:
        at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        at = np.arange(len(d))
    at = at[np.isfinite(d[at])]
    at = at[np.lexsort((ids[at], d[at]))][:k]
    return at, d[at]


FOUND = "query_id long, vec_id long, score double, leaf long"


def _found(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.repeat([q for q, *_ in rows], [len(i) for _, i, _, _ in rows]).astype(np.int64)]
    columns += [np.concatenate([r[k] for r in rows]) if rows else np.empty(0) for k in (1, 2, 3)]
    kinds = (np.int64, np.int64, np.float64, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score", "leaf"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact(placed: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """The true nearest of a bounded set of queries, against all rows in blocks."""
    shared = placed.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, qx = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            v, leaf, m = batch.column(0).to_numpy(), batch.column(2).to_numpy(), vectors(batch.column(1))
            for q, qv in zip(queries.tolist(), qx):
                at, d = nearest(qv, v, m, q, k)
                new = (v[at], d, leaf[at])
                if q in best:
                    new = tuple(np.concatenate(c) for c in zip(best[q], new))
                    keep = np.lexsort((new[0], new[1]))[:k]
                    new = tuple(c[keep] for c in new)
                best[q] = new
        yield _found([(q, *c) for q, c in best.items()])

    return _ranked(placed.select("vec_id", "vec", "leaf").mapInArrow(run, FOUND), k)


def _fit(spark: SparkSession, rows: DataFrame, n: int, sample: int, leaf: int) -> Tree:
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    got = some.select("vec").toArrow()  # at most sample rows
    x = vectors(got.column("vec").combine_chunks()) if got.num_rows else np.empty((0, 1))
    return Tree(x, max(2, int(leaf * len(x) / max(n, 1))))


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, sample: int = SAMPLE, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """The k nearest of each row whose identifier is divisible by every: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    rows = cut(take_part(df, id_col, vector_col))
    tree = _fit(spark, rows, rows.count(), sample, leaf)
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = shared.value.assign(vectors(batch.column(1))) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at)], names=["vec_id", "vec", "leaf"])

    placed = cut(rows.mapInArrow(place, "vec_id long, vec array<double>, leaf long"))
    queries = rows.filter(F.col("vec_id") % every == 0)
    others = rows.filter(F.col("vec_id") % every != 0)
    tried = (queries if every == 1 else others).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(CALIBRATION).collect()
    visits = tree.leaves
    if tried:
        ids, x = np.array([r["vec_id"] for r in tried]), np.array([r["vec"] for r in tried])
        needed: dict[int, list[int]] = {}
        for r in exact(placed, ids, x, k).select("query_id", "leaf").collect():  # CALIBRATION times k
            needed.setdefault(r["query_id"], []).append(r["leaf"])
        places = []
        for q, v in zip(ids.tolist(), x):
            order = {node: i + 1 for i, node in enumerate(tree.best_first(v))}
            places.append(sorted(order[n] for n in needed.get(q, [])))
        wanted = [p for p in places if p]
        visits = next((n for n in range(1, tree.leaves) if np.mean([np.searchsorted(p, n, "right") / len(p) for p in wanted]) >= recall), tree.leaves) if wanted else 1

    # a row per leaf, as many as the tree has
    counts = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    bucket_of, chunks_of = buckets(tree, counts)
    dealt = spark.sparkContext.broadcast((bucket_of, chunks_of, counts))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunks, held = dealt.value
        for batch in batches:
            x = vectors(batch.column(1))
            for a in range(0, batch.num_rows, 64):
                rows: list[tuple[int, int, int, list[int]]] = []
                for row, v in enumerate(x[a : a + 64], a):
                    meets: dict[int, list[int]] = {}
                    met = 0
                    for made, n in enumerate(shared.value.best_first(v)):
                        if made >= visits and met > k:  # more than k, as the query itself is one
                            break
                        meets.setdefault(own[n], []).append(n)
                        met += held.get(n, 0)
                    rows += [(row, b, c, leaves) for b, leaves in meets.items() for c in range(chunks[b])]
                at = pa.array([r[0] for r in rows], pa.int64())
                columns = [pa.array([r[n] for r in rows], t) for n, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["query_id", "q", "bucket", "chunk", "leaves"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunks, _ = dealt.value
        for batch in batches:
            bucket = np.array([own[n] for n in batch.column(2).to_pylist()], np.int64)
            many = np.array([chunks[b] for b in bucket.tolist()], np.int64)
            chunk = batch.column(3).to_numpy() % np.maximum(many, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(bucket), pa.array(chunk)], names=["vec_id", "vec", "leaf", "bucket", "chunk"])

    salted = placed.withColumn("salt", F.shiftrightunsigned(F.xxhash64("vec_id"), 1))
    left = salted.mapInArrow(deal, "vec_id long, vec array<double>, leaf long, bucket long, chunk long")
    asked = queries.mapInArrow(visit, "query_id long, q array<double>, bucket long, chunk long, leaves array<long>")

    def meet(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        if mine.num_rows and theirs.num_rows:
            leaf = mine.column("leaf").to_numpy()
            order = np.argsort(leaf, kind="stable")
            leaf, ids, x = leaf[order], mine.column("vec_id").to_numpy()[order], vectors(mine.column("vec").combine_chunks())[order]
            for q, v, leaves in zip(theirs.column("query_id").to_pylist(), vectors(theirs.column("q").combine_chunks()), theirs.column("leaves").to_pylist()):
                spans = [(a, b) for a, b in zip(np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, "right")) if b > a]
                if not spans:
                    continue
                some = np.concatenate([np.arange(a, b) for a, b in spans]) if sum(b - a for a, b in spans) < len(leaf) else slice(None)
                at, d = nearest(v, ids[some], x[some], q, k)
                out.append((q, ids[some][at], d, leaf[some][at]))
        return pa.Table.from_batches([_found(out)])

    found = left.groupBy("bucket", "chunk").cogroup(asked.groupBy("bucket", "chunk")).applyInArrow(meet, FOUND)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
