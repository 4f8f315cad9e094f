"""Whole runs: a tree to its module graph and call graph, the context of a change, a diff of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.facts import extract
from weftline.operators import callgraph, context, diff, incremental, resolve, traverse
from weftline.operators.lineage import cut
from weftline.sources import config as configs
from weftline.sources import documents, tree
from weftline.sources.provenance import provenance


def parse_errors(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'error'").select("file", "message")


def _checked(facts: DataFrame, files: DataFrame, on_error: str) -> DataFrame:
    """Scanned files that don't parse stop the run, or with on_error='skip' are left out; targets may be broken."""
    if on_error == "fail":
        bad = parse_errors(facts).join(files.select("file"), "file", "left_semi").orderBy("file").first()
        if bad:
            raise SyntaxError(f"{bad['file']}: {bad['message']}")
    return files.join(parse_errors(facts).select("file"), "file", "left_anti")


def scan(spark: SparkSession, root: str, config: dict | None = None, on_error: str = "fail") -> dict[str, DataFrame]:
    """files (file, hash), imports, unresolved, function_edges, and the facts and entries they come from."""
    if tree.is_exist(root) != "exists":
        raise NotADirectoryError(f"not a directory: {root}")
    paths = tree.paths(spark, root)
    kept = tree.scanned(paths, root, configs.exclude_pattern(config) if config else configs.EXCLUDED).filter("ext = '.py'")
    contents = tree.contents(spark, root)
    facts = cut(extract(contents))
    files = cut(_checked(facts, kept, on_error))
    graph = resolve.module_graph(facts, files, paths, tree.resolved_root(root))
    hashes = incremental.fingerprints(contents).join(files.select("file"), "file", "left_semi")
    own = facts.join(files.select("file"), "file", "left_semi")
    return {"files": hashes, "facts": own} | graph


def rescan(spark: SparkSession, root: str, cached_files: DataFrame, cached_facts: DataFrame, config: dict | None = None, on_error: str = "fail") -> tuple[dict[str, DataFrame], DataFrame]:
    """As scan(), parsing only files whose hash isn't cached; and the counts of cached, rescanned and removed files.

    cached_files and cached_facts cover every file of the tree, as targets need facts too; the
    second result's first row counts scanned files only where the cache holds those alone.
    """
    paths = tree.paths(spark, root)
    kept = tree.scanned(paths, root, configs.exclude_pattern(config) if config else configs.EXCLUDED).filter("ext = '.py'")
    current, facts = incremental.update(tree.contents(spark, root), cached_files, cached_facts)
    facts = cut(facts)
    files = cut(_checked(facts, kept, on_error))
    graph = resolve.module_graph(facts, files, paths, tree.resolved_root(root))
    own = facts.join(files.select("file"), "file", "left_semi")
    return {"files": current.join(files.select("file"), "file", "left_semi"), "facts": own, "all_files": current, "all_facts": facts} | graph, incremental.stats(current, cached_files)


def function_graph(result: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return callgraph.call_graph(result["facts"], result["entries"])


def build_and_analyze(spark: SparkSession, root: str, changed: list[str]) -> DataFrame:
    """One row per changed function with its direct and all of its callers."""
    calls = function_graph(scan(spark, root))["calls"].select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return traverse.blast_lists(calls, spark.createDataFrame([(c,) for c in changed], "seed string"))


def context_bundle(spark: SparkSession, root: str, changed: list[str], max_tokens: int = context.BUDGET, git: bool = True) -> dict:
    result = scan(spark, root)
    graph = function_graph(result)
    calls = graph["calls"].select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return context.bundle(graph["nodes"], calls, callgraph.definitions(result["facts"]), changed, max_tokens, provenance(root) if git else None)


def diff_snapshots(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {"files": diff.files(old["files"], new["files"]), "edges": diff.edges(old["imports"], new["imports"]), "unresolved": diff.unresolved(old["unresolved"], new["unresolved"])}


def diff_text(changes: dict[str, DataFrame]) -> str:
    lines = diff.report(changes["files"], changes["edges"], changes["unresolved"])
    return "\n".join(r["line"] for r in lines.orderBy("section", "ord").toLocalIterator())


def diff_files(spark: SparkSession, old: str, new: str) -> dict[str, DataFrame]:
    return diff_snapshots(documents.load_snapshot(spark, old), documents.load_snapshot(spark, new))
