"""Repeated passages, by a logarithmic family of sparse suffix arrays.

A byte goes if some string of MATCH bytes that covers it also starts anywhere else, in the
same document or another; overlaps count, and strings are judged on the input. Documents that
hold a string of PASSAGE bytes (some 50 words) that also starts elsewhere are marked.

Suffixes are sampled at anchors that the bytes themselves choose: a string of PASSAGE bytes has
as its anchor the leftmost of its smallest KEY-byte hashes. Equal strings have anchors at equal
offsets, so no match is lost, and an anchor serves some PASSAGE / 2 strings in a row. A string
stretches HALF bytes or more to the right of its anchor or to the left of it; accordingly an
anchor enters with the suffix that begins there, with the one that begins HALF bytes before,
or with both. Arrays are sorted by the suffixes' bytes, the first HEAD of them as they are, and
those that agree in these by a hash of the first HALF.

Documents come in batches. A batch gets its suffix array; merge-scanning it against each
existing level finds the suffixes that match over HALF bytes. Then it becomes a level, and
levels of equal size merge until none are equal, so a suffix is rewritten a logarithmic
number of times. Arrays hold a suffix once with its number of occurrences, so what a third of
all documents share is one entry. Levels lie under a path that a caller may keep (SuffixIndex),
so that batches of a later day meet those of today. A level's name says which batches it holds;
one that a wider level covers, as a lost driver may leave it, is ignored.

What matched is decided on the bytes around it: entries of equal surroundings (a hash of all their
strings) repeat each other's strings; where surroundings differ, one entry of each kind fetches its
bytes and the kinds of a key compare all their strings by two hashes modulo 2^31 - 1, at bases
drawn for the run (unequal strings agree with a chance of 4 in 10^14). Keys of very many kinds are
compared by a shuffle on the strings' hashes.

Null texts count as empty. Documents are told apart by identifier and text, null being an
identifier like others; repeated rows are repeated text. Texts shorter than MATCH bytes lose
nothing. Long texts are read STEP bytes at a time. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import file_system, join_groups, partitions, raw, scratch, settings

MATCH, PASSAGE, KEY = 400, 288, 16
HALF, HEAD = PASSAGE // 2, 32
BATCHES = 4
#: Kinds of one key that are compared in one task; keys of more go by a shuffle of strings.
KINDS = 20_000
#: Most frequent suffixes of a level whose entries aren't shuffled; entries whose strings are hashed at a time.
LARGEST, AT_ONCE = 1000, 1024
#: Bytes of a text in which anchors are chosen at a time.
STEP = 1 << 20

ENTRY = "batch int, head binary, h long, kind long, kind2 long, k1 long, k2 long, at int, low short, high short, low2 short"
ARRAY, SUFFIX, KIND = ["head", "h"], ["lead", "h"], ["lead", "h", "kind"]

_U = np.uint64
_PRIME = (1 << 31) - 1
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def drawn_bases() -> tuple[int, int]:
    return secrets.randbelow(_PRIME - 1000) + 500, secrets.randbelow(_PRIME - 1000) + 500


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo the prime."""
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate((out, out * _U(pow(base, len(out), _PRIME)) % _U(_PRIME)))
    return out[:n]


def hashed(data: bytes, start: np.ndarray, size: int, bases: tuple[int, int]) -> np.ndarray:
    """62 bits of each string of size bytes that begins at start; some megabytes of data at most."""
    x = np.frombuffer(data, np.uint8).astype(_U) + _U(1)
    n = 1 << max(16, len(x).bit_length())
    found = []
    for base in bases:
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(x * _powers(base, n)[: len(x)], dtype=_U)))
        found.append((sums[start + size] - sums[start]) % _U(_PRIME) * _powers(pow(base, -1, _PRIME), n)[start] % _U(_PRIME))
    return (found[0] << _U(31)) | found[1]


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every width neighbours, from running minima of blocks forwards and backwards."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, and the first and last start of the strings of PASSAGE bytes that each serves."""
    found = [(np.empty(0, np.int64),) * 3]
    for a in range(0, len(data) - PASSAGE + 1, STEP):
        gram = np.frombuffer(data[a : a + STEP + PASSAGE - 1], np.uint8).astype(_U) + _U(1)
        size = 1
        while size < KEY:  # hashes of twice the size, out of two neighbours
            gram = gram[:-size] * _U(pow(_BASE, size, 1 << 64)) + gram[size:]
            size *= 2
        # high bits by hash, low bits by place: the smallest is the leftmost of the smallest hashes
        ranked = (_mixed(gram) >> _U(31) << _U(31)) | np.arange(len(gram), dtype=_U)
        at = (sliding_minimum(ranked, PASSAGE - KEY + 1) & _U((1 << 31) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        last = np.concatenate((first[1:], [len(at)])) - 1
        found.append((at[first] + a, first + a, last + a))
    at, first, last = (np.concatenate(c) for c in zip(*found))
    new = np.concatenate(([True], np.diff(at) != 0)) if len(at) else np.empty(0, bool)  # one may serve both sides of a step
    return at[new], first[new], last[np.concatenate((new[1:], [True]))] if len(at) else last


def entries(data: bytes) -> tuple:
    """head, h, kind, kind2, at, low, high, low2 of a document's entries.

    low to high are the distances from the anchor at which strings of PASSAGE bytes begin before it,
    low2 to high those of strings of MATCH bytes, none if that is empty.
    """
    from xxhash import xxh3_64_intdigest as digest

    n = len(data)
    at, first, last = anchors(data)
    high, low = at - first, at - last
    right, left = low <= HALF, high > HALF
    at = np.concatenate((at[right], at[left]))
    low, high = np.concatenate((low[right], np.maximum(low[left], HALF + 1))), np.concatenate((np.minimum(high[right], HALF), high[left]))
    side = np.arange(len(at)) >= int(right.sum())
    begin = np.where(side, at - HALF, at)
    low2 = np.minimum(np.maximum(low, at + MATCH - n), high + 1)
    begins, sides = begin.tolist(), side.tolist()
    head = [data[b : b + HEAD] for b in begins]
    h = [digest(data[b : b + HALF], s) for b, s in zip(begins, sides)]
    starts, highs = (at - high).tolist(), high.tolist()
    kinds = []
    for size, lows in ((PASSAGE, low), (MATCH, low2)):
        kinds.append([digest(data[a:b], x * 1024 + y) for a, b, x, y in zip(starts, (at - lows + size).tolist(), lows.tolist(), highs)])
    return head, *(np.array(c, _U).view(np.int64) for c in (h, *kinds)), at, low, high, low2


def _identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2: 128 bits that tell documents apart; text: bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), raw(text_col).alias("text"))
    return rows.select("id", F.xxhash64(F.col("id").isNull(), "id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "id").alias("k2"), "text")


def sampled(rows: DataFrame, batches: int = 1) -> DataFrame:
    """All entries of rows (k1, k2, text), dealt into batches by document."""
    names = [c.split()[0] for c in ENTRY.split(", ")]
    kinds = [np.int32, None, np.int64, np.int64, np.int64, np.int64, np.int64, np.int32, np.int16, np.int16, np.int16]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([x for own in c for x in own], pa.binary()) if k is None else pa.array(np.concatenate(c).astype(k)) for c, k in zip(zip(*held), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        held, size = [], 0
        for part in parts:
            for k1, k2, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                if len(data := text.as_py()) < PASSAGE:
                    continue
                head, h, kind, kind2, at, low, high, low2 = entries(data)
                held.append((np.full(len(at), k1 % batches), head, h, kind, kind2, np.full(len(at), k1), np.full(len(at), k2), at, low, high, low2))
                size += len(at)
                if size >= 1 << 15:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return rows.select("k1", "k2", "text").mapInArrow(run, ENTRY)


class SuffixIndex:
    """Levels of sorted suffix arrays under a path, each a table: head, h, n occurrences."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, at = file_system(spark, self.path)
        names = [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []
        done = [tuple(map(int, m.groups())) for x in names if (m := re.fullmatch(r"level-(\d+)-(\d+)", x)) and self.fs.exists(file_system(spark, f"{self.path}/{x}/_SUCCESS")[1])]
        #: (first batch, last batch) of every level, the oldest and largest first.
        self.levels = sorted(x for x in done if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in done))

    def level(self, of: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema("head binary, h long, n long").parquet(f"{self.path}/level-{of[0]}-{of[1]}")

    def _write(self, suffixes: DataFrame, n: str, of: tuple[int, int]) -> DataFrame:
        counted = suffixes.groupBy(*ARRAY).agg(F.sum(n).alias("n"))
        ordered = counted.repartitionByRange(partitions(self.spark), *ARRAY).sortWithinPartitions(*ARRAY)
        ordered.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/level-{of[0]}-{of[1]}")
        return self.level(of)

    def largest(self, n: int) -> DataFrame:
        """The n most frequent suffixes of each level."""
        out = None
        for of in self.levels:
            top = self.level(of).orderBy(F.desc("n"), *ARRAY).limit(n).select(*ARRAY)
            out = top if out is None else out.union(top)
        return out.distinct()

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch's entries (head, h); returns the suffixes that match, within the batch or with what came before."""
        number = self.levels[-1][1] + 1 if self.levels else 0
        array = self._write(batch.select(*ARRAY, F.lit(1).cast("long").alias("one")), "one", (number, number))
        found = array.filter("n > 1").select(*ARRAY)
        for of in self.levels:
            found = found.union(array.select(*ARRAY).join(self.level(of).select(*ARRAY).hint("merge"), ARRAY))
        found.write.option("compression", "zstd").parquet(path := scratch(self.spark, "matches"))
        now = (number, number)
        while self.levels and self.levels[-1][1] - self.levels[-1][0] == now[1] - now[0]:
            before = self.levels.pop()
            merged = (before[0], now[1])
            self._write(self.level(now).union(self.level(before)), "n", merged)
            for old in (before, now):
                self.fs.delete(file_system(self.spark, f"{self.path}/level-{old[0]}-{old[1]}")[1], True)
            now = merged
        self.levels.append(now)
        return self.spark.read.schema("head binary, h long").parquet(path)


WINDOW = "lead long, h long, kind long, d short, w long"
RUN = "lead long, h long, kind long, low short, high short"


def strings(low: np.ndarray, high: np.ndarray, data: list[bytes], size: int, bases: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the strings of some entries from their bytes, with each one's entry and its distance before the anchor."""
    out: list[tuple[np.ndarray, ...]] = [(np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64))]
    for k in range(0, len(data), AT_ONCE):
        some = data[k : k + AT_ONCE]
        many = (high - low + 1)[k : k + AT_ONCE]
        begin = np.cumsum([0, *map(len, some)])[:-1]
        which = np.repeat(np.arange(len(some)), many)
        within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        d, start = high[k + which] - within, begin[which] + within
        out.append((_mixed(hashed(b"".join(some), start, size, bases) + (d.astype(_U) << _U(50))), which + k, d))
    return tuple(np.concatenate(c) for c in zip(*out))


def decide(parts: Iterator[pa.RecordBatch], size: int, bases: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The strings of size bytes that repeat among the kinds of each key; expects lead, h, kind, low, high, data, sorted by the first three."""

    def keys(*columns: np.ndarray) -> np.ndarray:
        """Where a row differs from the one before."""
        return np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))

    def settle(lead, h, kind, low, high, data) -> pa.RecordBatch:
        one = np.flatnonzero(keys(lead, h, kind))  # repeated rows fetch the same entry
        lead, h, kind, low, high = (c[one] for c in (lead, h, kind, low, high))
        w, which, d = strings(low, high, [data[k] for k in one.tolist()], size, bases)
        group = np.cumsum(keys(lead, h))[which]
        w = w + _mixed(group.astype(_U))
        order = np.argsort(w, kind="stable")
        same = np.flatnonzero((w[order][1:] == w[order][:-1]) & (group[order][1:] == group[order][:-1]))
        again = np.zeros(len(w), bool)
        again[order[same]] = again[order[same + 1]] = True
        at = np.flatnonzero(again)
        new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(which[at]) != 0))) if len(at) else np.empty(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(at)]))[: len(first)] - 1
        row = which[at[first]]
        columns = [lead[row], h[row], kind[row], d[at[last]].astype(np.int16), d[at[first]].astype(np.int16)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lead", "h", "kind", "low", "high"])

    kept: list = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.int64)] * 2 + [[]]
    for part in parts:
        new = [part.column(k).to_numpy().astype(np.int64) for k in range(5)] + [part.column(5).to_pylist()]
        rows = [np.concatenate(x) for x in zip(kept[:5], new[:5])] + [kept[5] + new[5]]
        if not len(rows[0]):
            continue
        end = int(np.flatnonzero(keys(rows[0], rows[1]))[-1])
        if end:
            yield settle(*(c[:end] for c in rows))
        kept = [c[end:] for c in rows]
    if len(kept[5]):
        yield settle(*kept)


def matched(docs: DataFrame, id_col: str, text_col: str, batches: int = BATCHES, index_path: str | None = None) -> DataFrame:
    """The entries whose suffixes occur again, a row each for PASSAGE and for MATCH bytes: size, lead, h, kind, k1, k2, at, low, high."""
    spark = docs.sparkSession
    path = scratch(spark, "entries")
    sampled(_identity(docs, id_col, text_col), batches).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    every = spark.read.schema(ENTRY).option("basePath", path).parquet(path)
    index, found = SuffixIndex(spark, index_path or scratch(spark, "index")), None
    for b in range(batches):
        new = index.add(every.filter(F.col("batch") == b))
        found = new if found is None else found.union(new)
    # from here on heads are told apart by a hash: entries are joined, not sorted
    short = [F.xxhash64("head").alias("lead"), "h"]
    found = found.select(*short).distinct()
    every = every.select(*short, "kind", "kind2", "k1", "k2", "at", "low", "high", "low2")
    # entries of the most frequent suffixes stay where they are; a fixed number of suffixes goes to them
    top = F.broadcast(index.largest(LARGEST).select(*short).join(found, SUFFIX, "left_semi"))
    rest = every.join(top, SUFFIX, "left_anti").join(found, SUFFIX, "left_semi")
    both = every.join(top, SUFFIX, "left_semi").unionByName(rest)
    sizes = F.array(F.struct(F.lit(PASSAGE).alias("size"), "kind", "low"), F.struct(F.lit(MATCH).alias("size"), F.col("kind2").alias("kind"), F.col("low2").alias("low")))
    rows = both.select("lead", "h", "k1", "k2", "at", "high", F.explode(sizes).alias("s")).select("s.size", "lead", "h", "s.kind", "k1", "k2", "at", "s.low", "high")
    rows.filter("low <= high").write.partitionBy("size").option("compression", "zstd").parquet(path := scratch(spark, "matched"))
    return spark.read.option("basePath", path).schema("lead long, h long, kind long, k1 long, k2 long, at int, low short, high short, size int").parquet(path)


def repeated(docs: DataFrame, id_col: str, text_col: str, entries: DataFrame, size: int, kinds: int = KINDS) -> DataFrame:
    """k1, k2, s (a, b): the stretches of each document that strings of size bytes repeat."""
    spark, bases = docs.sparkSession, drawn_bases()
    own = entries.filter(F.col("size") == size).drop("size")
    kind = own.groupBy(*KIND).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one"), F.first("low").alias("low"), F.first("high").alias("high"))
    kind.write.parquet(path := scratch(spark, "kinds"))
    kind = spark.read.parquet(path)
    # keys of several kinds, of which some may share strings with a kind that has no copies
    several = kind.groupBy(*SUFFIX).agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("single")).filter("kinds > 1 and single > 0")
    ask = kind.join(several, SUFFIX).select(*KIND, F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2"), F.col("one.at").alias("at"), "low", "high", (F.col("kinds") > kinds).alias("many"))
    wanted = ask.groupBy("k1", "k2").agg(F.collect_list(F.struct(*KIND, "at", "low", "high", "many")).alias("asks"))
    texts = _identity(docs, id_col, text_col).select("k1", "k2", "text").join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select(F.explode("asks").alias("a"), "text")
    data = F.expr(f"substring(text, a.at - a.high + 1, a.high - a.low + {size})")
    fetched = texts.select(*(F.col(f"a.{c}").alias(c) for c in (*KIND, "low", "high", "many")), data.alias("data"))
    fetched.write.parquet(path := scratch(spark, "surroundings"))
    fetched = spark.read.schema(f"{RUN}, many boolean, data binary").parquet(path)
    few = fetched.filter("not many").drop("many").repartition(partitions(spark), *SUFFIX).sortWithinPartitions(*KIND).mapInArrow(lambda parts: decide(parts, size, bases), RUN)

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            w, which, d = strings(*(part.column(k).to_numpy().astype(np.int64) for k in (3, 4)), part.column(5).to_pylist(), size, bases)
            rows = pa.array(which)
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in range(3)), pa.array(d.astype(np.int16)), pa.array(w.view(np.int64))], names=["lead", "h", "kind", "d", "w"])

    windows = fetched.filter("many").drop("many").mapInArrow(each, WINDOW).distinct()
    held = windows.groupBy(*SUFFIX, "w", "d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = join_groups(windows, held, [*SUFFIX, "w", "d"], "n").select(*KIND, F.col("d").alias("low"), F.col("d").alias("high"))
    copied = kind.filter("n > 1").select(*KIND, "low", "high")
    runs = copied.unionByName(few).unionByName(many).groupBy(*KIND).agg(F.collect_list(F.struct("low", "high")).alias("runs")).join(kind.select(*KIND, "n"), KIND)
    runs.write.parquet(path := scratch(spark, "runs"))
    runs = spark.read.parquet(path)
    hit = join_groups(own.select(*KIND, "k1", "k2", "at"), runs, KIND, "n")
    return hit.select("k1", "k2", F.explode(F.transform("runs", lambda r: F.struct((F.col("at") - r["high"]).alias("a"), (F.col("at") - r["low"] + size).alias("b")))).alias("s"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, kinds: int = KINDS, index_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay), passage (whether it holds a repeated string of PASSAGE bytes).

    index_path keeps the suffix levels for batches to come; without it they go.
    """
    spark = docs.sparkSession
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        every = matched(docs, id_col, text_col, batches, index_path)
        long = repeated(docs, id_col, text_col, every, MATCH, kinds).groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))
        short = repeated(docs, id_col, text_col, every, PASSAGE, kinds).select("k1", "k2").distinct()
        short.join(long, ["k1", "k2"], "left").write.parquet(path := scratch(spark, "spans"))  # a longer string holds shorter ones
    spans = spark.read.parquet(path).withColumn("passage", F.lit(True))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[list] = [[], [], [], []]
            for text, found in zip(part.column(1), part.column(2).to_pylist()):
                data, kept, end, removed, n = text.as_py(), [], 0, 0, 0
                for a, b in sorted((s["a"], s["b"]) for s in found or ()):
                    if a > end or not n:
                        kept.append(data[end:a])
                        n += 1
                        removed += b - a
                        end = b
                    elif b > end:
                        removed += b - end
                        end = b
                for column, value in zip(rows, (len(data), removed, n, b"".join([*kept, data[end:]]))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.binary()), part.column(3)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "passage"])

    held = _identity(docs, id_col, text_col).join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("id", "text", "spans", F.coalesce("passage", F.lit(False)).alias("passage"))
    return held.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, passage boolean")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage."""
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "passage")
