"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): root is the component's smallest node.

    Every round links each node's larger neighbours to its smallest one, then the
    smaller ones likewise, until all is stars around their smallest nodes; edges never
    outnumber those given.
    """
    state = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not _stars(state):
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _stars(state: DataFrame) -> bool:
    """Whether every larger end u of the edges (u, v) has one edge, and is no smaller end."""
    ends = state.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(state.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 or up = 1 and down = 1").isEmpty()
