"""The dependency graph that the test tables hold: order on customer, part and supplier; part on supplier;
customer and supplier on nation; nation on region. Nodes are prefixed keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


#: table, prefix and column of the source, prefix and column of the target.
LINKS = [
    ("orders", "o", "o_orderkey", "c", "o_custkey"),
    ("lineitem", "o", "l_orderkey", "p", "l_partkey"),
    ("lineitem", "o", "l_orderkey", "s", "l_suppkey"),
    ("lineitem", "p", "l_partkey", "s", "l_suppkey"),
    ("customer", "c", "c_custkey", "n", "c_nationkey"),
    ("supplier", "s", "s_suppkey", "n", "s_nationkey"),
    ("nation", "n", "n_nationkey", "r", "n_regionkey"),
]
#: table, prefix and column of the nodes.
NODES = [("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"), ("part", "p", "p_partkey"), ("orders", "o", "o_orderkey")]


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst), parallel edges kept."""
    return reduce(DataFrame.union, (table(spark, sf_dir, t).select(_node(a, x).alias("src"), _node(b, y).alias("dst")) for t, a, x, b, y in LINKS))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.union, (table(spark, sf_dir, t).select(_node(a, x).alias("node")) for t, a, x in NODES))


EDGES_SQL = "select distinct src, dst from (" + " union all ".join(f"select '{a}:' || {x} as src, '{b}:' || {y} as dst from {t}" for t, a, x, b, y in LINKS) + ")"
NODES_SQL = " union all ".join(f"select '{a}:' || {x} as node from {t}" for t, a, x in NODES)
