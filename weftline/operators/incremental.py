"""Re-analysis of what changed only.

Facts depend on a file's content alone, so they are cached by path and hash and the resolver
runs over all of them again: an edit elsewhere can't leave stale edges. With stale_ok the
edges themselves come from the cache, as a cache of per-file results would serve them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.facts import extract


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("file", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


def split(current: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reusable, to analyse): files whose cached hash is the current one, and all others. Both: file, hash."""
    keys = cached.select("file", "hash").distinct()
    return current.join(keys, ["file", "hash"], "left_semi"), current.join(keys, ["file", "hash"], "left_anti")


def stats(current: DataFrame, cached: DataFrame) -> DataFrame:
    """One row: cached, rescanned, removed_from_cache."""
    both = current.select("file", F.col("hash").alias("new")).join(cached.select("file", F.col("hash").alias("old"), F.lit(True).alias("was")), "file", "full")
    same = F.coalesce(F.col("new") == F.col("old"), F.lit(False))
    return both.agg(F.count_if(same).alias("cached"), F.count_if(F.col("new").isNotNull() & ~same).alias("rescanned"), F.count_if(F.col("new").isNull()).alias("removed_from_cache"))


def update(files: DataFrame, cached_files: DataFrame, cached_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, facts) of the current tree, parsing changed files only; what is gone is dropped.

    files: file, content. cached_files: file, hash; cached_facts: as extracted then.
    """
    current = fingerprints(files)
    keep, todo = split(current, cached_files)
    fresh = extract(files.join(todo.select("file"), "file", "left_semi"))
    return current, cached_facts.join(keep.select("file"), "file", "left_semi").unionByName(fresh)


def merge_edges(current: DataFrame, cached_files: DataFrame, cached_edges: DataFrame, fresh_edges: DataFrame, stale_ok: bool = False) -> DataFrame:
    """Edges after an update: all fresh, or with stale_ok those of unchanged files as cached."""
    if not stale_ok:
        return fresh_edges
    keep, todo = split(current, cached_files)
    return cached_edges.join(keep.select("file"), "file", "left_semi").unionByName(fresh_edges.join(todo.select("file"), "file", "left_semi"))
