"""Functions and their calls: same-file function, same-file method, imported name, else unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.resolve import bindings

# Fixed texts.
NOT_NAMED = "callee is not a simple name/attribute"
UNKNOWN = "not found among this file's imports, same-file defs, or same-class methods"


def function_id(file: str = "file", name: str = "qualname") -> F.Column:
    return F.concat(F.col(file), F.lit("::"), F.col(name))


def call_graph(facts: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """nodes (fid, file, name), calls (caller, ord, callee), unresolved_calls (caller, ord, raw, line, reason).

    facts and entries are those of the scanned files.
    """
    defs = facts.filter("fact = 'def'").select("file", "qualname", "ord")
    calls = facts.filter("fact = 'call'").select("file", "qualname", "ord", "line", "call_name", "raw")
    same = defs.select("file", F.col("qualname").alias("call_name"), F.col("qualname").alias("own"))
    dotted = F.split("qualname", r"\.")
    methods = defs.filter(F.contains("qualname", F.lit("."))).groupBy("file", F.element_at(dotted, -1).alias("call_name")).agg(F.max_by("qualname", "ord").alias("method"))
    # the last of a module's top-level bindings of a name
    bound = bindings(entries.filter("top_level")).groupBy("file", F.col("bound").alias("call_name")).agg(F.max_by(F.struct("target"), "ord").alias("b")).select("file", "call_name", F.col("b.target").alias("target")).filter("target is not null and target <> ''")
    there = defs.select(F.col("file").alias("target"), F.col("qualname").alias("call_name"), F.lit(True).alias("defined"))
    held = calls.join(same, ["file", "call_name"], "left").join(methods, ["file", "call_name"], "left").join(bound, ["file", "call_name"], "left").join(there, ["target", "call_name"], "left")
    caller = F.concat(F.col("file"), F.lit("::"), F.col("qualname"))
    callee = (
        F.when(F.col("own").isNotNull(), F.concat("file", F.lit("::"), "own"))
        .when(F.col("method").isNotNull(), F.concat("file", F.lit("::"), "method"))
        .when(F.col("target").isNotNull() & F.col("defined"), F.concat("target", F.lit("::"), "call_name"))
    )
    elsewhere = F.concat(F.lit("imported from "), "target", F.lit(" but not found among its function/method defs"))
    reason = F.when(F.col("call_name").isNull(), NOT_NAMED).when(F.col("target").isNotNull(), elsewhere).otherwise(UNKNOWN)
    held = held.select(caller.alias("caller"), "ord", callee.alias("callee"), "raw", "line", reason.alias("reason"))
    return {
        "nodes": defs.select(function_id().alias("fid"), "file", F.col("qualname").alias("name")),
        "calls": held.filter("callee is not null").select("caller", "ord", "callee"),
        "unresolved_calls": held.filter("callee is null").select("caller", "ord", "raw", "line", "reason"),
    }


def definitions(facts: DataFrame) -> DataFrame:
    """(fid, source, signature, start_line, end_line) of each function's first definition."""
    return facts.filter("fact = 'def'").select(function_id().alias("fid"), "source", "signature", F.col("line").alias("start_line"), "end_line")


def nested(graph: dict[str, DataFrame]) -> DataFrame:
    """One row per function with its calls and unresolved calls as ordered lists, duplicates kept."""
    calls = graph["calls"].groupBy(F.col("caller").alias("fid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "callee"))), lambda x: x["callee"]).alias("calls"))
    open_ = graph["unresolved_calls"].groupBy(F.col("caller").alias("fid")).agg(F.array_sort(F.collect_list(F.struct("ord", "raw", "line", "reason"))).alias("unresolved_calls"))
    out = graph["nodes"].join(calls, "fid", "left").join(open_, "fid", "left")
    return out.withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
