"""Edges, degrees, hubs and neighbourhoods of a module graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hubs reported.
HUBS = 5


def distinct_edges(imports: DataFrame) -> DataFrame:
    """(src, dst) once each, of entries with a target. imports: src, dst."""
    return imports.filter("dst is not null and dst <> ''").select("src", "dst").distinct()


def outgoing(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("targets"))


def incoming(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("sources"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, degree) of every node, edges being distinct; a loop counts twice."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    many = [F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("i", "o")]
    return nodes.select("node").join(sums, "node", "left").select("node", many[0].alias("in_degree"), many[1].alias("out_degree"), (many[0] + many[1]).alias("degree"))


def max_degree(stats: DataFrame) -> DataFrame:
    return stats.agg(F.coalesce(F.max("degree"), F.lit(0)).cast("long").alias("max_degree"))


def hubs(stats: DataFrame, k: int = HUBS) -> DataFrame:
    """The k nodes of highest degree, ties by node."""
    return stats.filter("degree > 0").orderBy(F.desc("degree"), "node").limit(k)


def neighbourhood(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected nodes (column node) and whatever is one edge away."""
    out = edges.join(selected, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node"))
    into = edges.join(selected, F.col("dst") == F.col("node"), "left_semi").select(F.col("src").alias("node"))
    return selected.select("node").union(out).union(into).distinct()


def highlighted(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with both ends in the neighbourhood."""
    near = neighbourhood(edges, selected)
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def summary(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame, function_edges: DataFrame) -> DataFrame:
    """One row: files, edges, unresolved entries that need attention, function edges."""
    from weftline.operators.rollup import expected

    counts = [nodes.agg(F.count(F.lit(1)).alias("files")), edges.agg(F.count(F.lit(1)).alias("edges")), unresolved.agg(F.count_if(~expected("reason")).alias("attention")), function_edges.agg(F.count(F.lit(1)).alias("function_edges"))]
    out = counts[0]
    for c in counts[1:]:  # one row each
        out = out.join(F.broadcast(c))
    return out
