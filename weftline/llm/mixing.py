"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in order of their identifiers, form blocks. With weight w, its
block k (from 0) is released at floor(k / w) and due at ceil((k + 1) / w); in every slot
the released block that is due first goes next. Weights that sum to one make this
feasible, and after any number of slots a source is less than one block from its share.
Weights are taken as the exact fractions that they are, so this holds against the very
weights given, over any number of slots.

Where a source is used up a new phase begins, in which the others share its weight in
proportion; no document is dropped or repeated.

A block has BLOCK documents, or as many more as keep all blocks to some BLOCKS: what is scheduled
slot by slot is bounded, whatever the number of documents, and is a table of a block's slot,
by which the executors place their rows.

So is the number of streams that are scheduled at once, by one rule for any number of sources.
Without weights, sources lie in a tree by the hash of their names: STREAMS groups, DIRECT
groups in each, MEMBERS groups in each of these. A group has the sum of its members' weights.
Its slots go to its members by a Pfair schedule of its own, worked out on the executors: a member
is less than one block from its share of the group's slots, and takes over what used-up members of
its group leave. A group of one member is that member, so where no two names meet in a group the
sources are scheduled against each other as they are. What other sources there are doesn't change
a source's groups.

The default weights temper the sources' shares of documents by an exponent below one.

Null and empty sources are one source. Rows with equal source and identifier, null
included, share a place. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, free_name, partitions, small_enough

#: Documents in a block at least, blocks in all (but for one more a source), exponent of the default weights.
BLOCK, BLOCKS, TEMPER = 64, 1 << 18, 0.7
#: Groups of sources by the hash of the name, groups in each of these, and again in each of those.
STREAMS, DIRECT, MEMBERS = 1024, 512, 512
REST = "(rest)"
#: Rows of the (source, partition) table that may go by broadcast.
BROADCAST_RUNS = 200_000

PLAN = "stream string, block long, slot long"


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of some positive weights."""
    exact = [Fraction(w) for w in weights]
    if min(exact) <= 0:
        raise ValueError("weights must be positive")
    scale = lcm(*(x.denominator for x in exact))
    return [int(x * scale) for x in exact]


def plan_rows(blocks: dict[str, int], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """(stream, block, slot) of every block, earliest deadline first among the released."""
    names = sorted(k for k, n in blocks.items() if n)
    share, done, slot, rows = dict(zip(names, whole([weights[k] for k in names]) if names else [])), dict.fromkeys(names, 0), 0, []
    while names:  # a phase: until one of them is used up
        total, now = sum(share[n] for n in names), 0
        waiting = [(0, n, 0) for n in names]  # release, stream, block of this phase
        ready: list[tuple[int, str, int]] = []  # deadline, stream, block of this phase
        before, name = dict(done), ""
        while not name or done[name] < blocks[name]:
            while waiting and waiting[0][0] <= now:
                _, n, k = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(k + 1) * total // share[n]), n, k))
            _, name, k = heapq.heappop(ready)
            rows.append((name, before[name] + k, slot))
            done[name] += 1
            slot, now = slot + 1, now + 1
            heapq.heappush(waiting, ((k + 1) * total // share[name], name, k + 1))
        names = [n for n in names if done[n] < blocks[n]]
    return rows


def placed_by(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """rows (unit, block) with slot, the block's place by plan; bounded plans go by broadcast."""
    plan = plan.withColumnRenamed("stream", "unit")
    return rows.join(F.broadcast(plan) if small else plan, ["unit", "block"])


def tree(source: str) -> list[F.Column]:
    """The groups of a source, from the smallest up."""
    h, names, at = F.xxhash64(source), [], F.lit("\0")
    for n in (STREAMS, DIRECT, MEMBERS):
        at, h = F.concat(at, F.pmod(h, F.lit(n)).cast("string"), F.lit(":")), F.xxhash64(h)
        names.insert(0, at)
    return names


def schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, block: int = BLOCK, blocks: int = BLOCKS, temper: float = TEMPER) -> DataFrame:
    """One row per distinct source and identifier: doc_id, source, stream, block, slot, position.

    weights names streams; sources that it doesn't name share one stream, REST, with what the key ''
    gets, or the mean of the named weights. Without weights every source is a stream.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    keys = docs.select(source.alias("source"), F.col(id_col).cast("long").alias("doc_id")).distinct()
    rest = "\0"
    stream = F.when(F.col("source").isin([k for k in weights if k]), F.col("source")).otherwise(F.lit(rest)) if weights else F.col("source")
    dealt = keys.withColumn("stream", stream)
    dealt = dealt.repartitionByRange(partitions(spark), "stream", "doc_id", "source").sortWithinPartitions("stream", "doc_id", "source")
    dealt = cut(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    runs = cut(dealt.groupBy("stream", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")))
    total = runs.agg(F.sum("n")).first()[0] or 0
    block = max(block, -(-total // blocks))
    runs = cut(runs.withColumn("before", F.sum("n").over(Window.partitionBy("stream").orderBy("part")) - F.col("n")))
    ranked = dealt.join(F.broadcast(runs.select("stream", "part", "first", "before")) if small_enough(runs, BROADCAST_RUNS) else runs.select("stream", "part", "first", "before"), ["stream", "part"])
    ranked = ranked.withColumn("rank", F.col("at") - F.col("first") + F.col("before")).withColumn("block", F.floor(F.col("rank") / block))

    n = F.sum("n")
    units = cut(runs.groupBy(F.col("stream").alias("unit")).agg(n.alias("n")).withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(temper)))))
    plans = []  # of the groups of more than one member, from the sources up: plan, unit to group
    if not weights:
        total_weight = F.aggregate(F.array_sort(F.collect_list("weight")), F.lit(0.0), lambda x, y: x + y)  # in one order, for one sum
        left = cut(units.select("unit", "n", "blocks", "weight", F.array(*tree("unit")).alias("groups")))
        for level in range(3):
            members = left.withColumn("group", F.col("groups")[level])
            several = members.groupBy("group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("group")
            inside = cut(members.join(several, "group", "left_semi"))
            if inside.isEmpty():
                continue

            def work_out(group: pd.DataFrame) -> pd.DataFrame:
                group = group.sort_values("unit")
                names = group["unit"].tolist()
                found = plan_rows(dict(zip(names, group["blocks"].tolist())), dict(zip(names, group["weight"].tolist())))
                return pd.DataFrame(found, columns=[c.split()[0] for c in PLAN.split(", ")])

            plan = cut(inside.select("unit", "blocks", "weight", "group").groupBy("group").applyInPandas(work_out, PLAN))
            plans.append((plan, inside.select("unit", "group")))
            alone = members.join(several, "group", "left_anti").select(*left.columns)
            made = inside.groupBy(F.col("group").alias("unit")).agg(n.alias("n"), F.sum("blocks").alias("blocks"), total_weight.alias("weight"), F.first("groups").alias("groups"))
            left = cut(alone.unionByName(made))
        units = left
    top = {r["unit"]: r for r in units.collect()}  # STREAMS rows at most, or the given weights and one more
    shares = {k: r["weight"] for k, r in top.items()}
    if weights:
        shares = {k: weights.get(k, weights.get("", sum(weights.values()) / len(weights))) for k in top}
    root = spark.createDataFrame(plan_rows({k: r["blocks"] for k, r in top.items()}, shares), PLAN)

    # a block of documents, then the group's block that its slot there is, and so on up
    own = cut(ranked.select("stream", "block").distinct()) if plans else None
    if plans:
        now = own.select("stream", F.col("block").alias("own_block"), F.col("stream").alias("unit"), "block")
        for plan, groups in plans:
            inner = now.join(groups, "unit")
            outer = now.join(groups, "unit", "left_anti")
            inner = placed_by(inner, plan, False).select("stream", "own_block", F.col("group").alias("unit"), F.col("slot").alias("block"))
            now = cut(outer.select("stream", "own_block", "unit", "block").unionByName(inner))
        slots = cut(placed_by(now, root, True).select("stream", F.col("own_block").alias("block"), "slot"))
        placed = ranked.join(slots, ["stream", "block"])
    else:
        placed = placed_by(ranked.withColumn("unit", F.col("stream")), root, True)
    named = F.when(F.col("stream") == rest, REST).otherwise(F.col("stream")) if weights else F.col("stream")
    return placed.select("doc_id", "source", named.alias("stream"), "block", "slot", (F.col("slot") * block + F.pmod("rank", F.lit(block))).alias("position"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """docs in the order of the schedule: partitions, and rows within them, ascend in position."""
    i, s, p = free_name(docs, "mix_id", "mix_source", "mix_position")
    places = schedule(docs, id_col, source_col, **how).select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("position").alias(p))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.coalesce(F.col(source_col).cast("string"), F.lit("")) == F.col(s))
    placed = docs.join(places, same)
    return placed.repartitionByRange(partitions(docs.sparkSession), p).sortWithinPartitions(p).select(*docs.columns)
