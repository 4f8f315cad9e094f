"""Python sources made from the test tables, whose graphs are known without parsing.

One module per customer and per supplier, in a directory per region and nation. A customer
imports every supplier it buys from, relatively if of the same nation, and calls the function
that it bound last; every module of a customer also imports from the standard library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.facts import extract
from weftline.operators import callgraph, resolve
from weftline.operators.lineage import cut
from weftline.plans.key_graph import table

ROOT = "/corpus"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string")).alias("place"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content)."""
    place = _places(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("place").alias("s_place"))
    customers = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "place")
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    near = F.concat(F.lit("from .s"), F.col("s_suppkey").cast("string"), F.lit(" import ship"))
    far = F.concat(F.lit("from "), F.translate("s_place", "/", "."), F.lit(".s"), F.col("s_suppkey").cast("string"), F.lit(" import ship"))
    lines = bought.join(suppliers, "s_suppkey").join(customers.select("c_custkey", "c_nationkey"), "c_custkey")
    lines = lines.select("c_custkey", "s_suppkey", F.when(F.col("s_nationkey") == F.col("c_nationkey"), near).otherwise(far).alias("line"))
    lists = lines.groupBy("c_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    text = F.concat(F.lit("import os\n"), F.coalesce("lines", F.lit("")), F.lit("\n\n\ndef buy():\n    ship()\n"))
    path = lambda p, k, c: F.concat(F.lit(ROOT + "/"), F.col(p), F.lit("/" + k), F.col(c).cast("string"), F.lit(".py"))
    own = customers.join(lists, "c_custkey", "left").select(path("place", "c", "c_custkey").alias("file"), text.alias("content"))
    return own.union(suppliers.select(path("s_place", "s", "s_suppkey").alias("file"), F.lit("def ship():\n    pass\n").alias("content")))


def paths(files: DataFrame) -> DataFrame:
    """(path, is_dir) of a tree that holds these files and the directories above them."""
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = files.select(F.explode(above).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    return files.select(F.col("file").alias("path"), F.lit(False).alias("is_dir")).union(dirs)


def graphs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    files = modules(spark, sf_dir)
    facts = cut(extract(files))
    names = facts.select("file").distinct()
    graph = resolve.module_graph(facts, names, paths(names), ROOT)
    return graph | callgraph.call_graph(facts, graph["entries"])


_BOUGHT = f"""
with place as (select n_nationkey, 'r' || n_regionkey || '/n' || n_nationkey as place from nation),
s as (select s_suppkey, s_nationkey, '{ROOT}/' || place || '/s' || s_suppkey || '.py' as s_file, replace(place, '/', '.') as s_mod from supplier join place on s_nationkey = n_nationkey),
c as (select c_custkey, c_nationkey, '{ROOT}/' || place || '/c' || c_custkey || '.py' as c_file from customer join place on c_nationkey = n_nationkey),
b as (select distinct c_custkey, l_suppkey as s_suppkey from orders join lineitem on o_orderkey = l_orderkey join customer on c_custkey = o_custkey),
e as (select c_file, s_file, s_suppkey, case when s_nationkey = c_nationkey then '.s' || s_suppkey else s_mod || '.s' || s_suppkey end as raw from b join s using (s_suppkey) join c using (c_custkey))
"""
IMPORTS_SQL = _BOUGHT + "select c_file as file, 'from_import' as kind, raw, 'ship' as imported_name, s_file as resolved_file, 'name_inside_module' as resolution from e"
UNRESOLVED_SQL = _BOUGHT + f"select c_file as file, 'import' as kind, 'os' as raw, '{resolve.STDLIB}' as reason from c"
CALLS_SQL = _BOUGHT + "select c_file || '::buy' as caller, arg_max(s_file, s_suppkey) || '::ship' as callee from e group by c_file"
