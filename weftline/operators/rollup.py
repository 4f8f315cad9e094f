"""Classification of unresolved entries, path arithmetic, directory roll-ups and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expected(reason: str | Column = "reason") -> Column:
    """Whether an unresolved entry is none of the project's business."""
    c = F.col(reason) if isinstance(reason, str) else reason
    return F.coalesce(c, F.lit("")).rlike("(?i)stdlib|third-party")


def classified(unresolved: DataFrame) -> DataFrame:
    return unresolved.withColumn("status", F.when(expected(), "expected").otherwise("attention"))


def counts_per_file(unresolved: DataFrame) -> DataFrame:
    """(file, attention, expected) of the entries that name a file."""
    rows = unresolved.filter("file is not null and file <> ''")
    return rows.groupBy("file").agg(F.count_if(~expected()).alias("attention"), F.count_if(expected()).alias("expected"))


def short_name(path: str | Column) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce(F.element_at(F.split(c, r"[\\/]"), -1), F.lit(""))


def common_prefix(files: DataFrame) -> DataFrame:
    """One row, prefix: the leading directories that all paths (column file) share.

    Parts compare position by position: a position counts if every path has a directory
    there, the same, and all positions before it count.
    """
    parts = F.split("file", r"[\\/]")
    places = files.select(F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("at", "part"))
    agreed = places.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    total = files.agg(F.count(F.lit(1)).alias("total"))
    # a row per depth, not per file
    held = agreed.join(F.broadcast(total)).filter("n = total and lo = hi").agg(F.sort_array(F.collect_list(F.struct("at", "lo"))).alias("all"))
    unbroken = F.filter("all", lambda x, i: x["at"] == i)
    return held.select(F.array_join(F.transform(unbroken, lambda x: x["lo"]), "/").alias("prefix"))


def relative(path: Column, prefix: Column) -> Column:
    inside = (prefix != "") & path.startswith(F.concat(prefix, F.lit("/")))
    return F.when(inside, path.substr(F.length(prefix) + 2, F.length(path))).otherwise(path)


def relative_paths(files: DataFrame) -> DataFrame:
    return files.join(F.broadcast(common_prefix(files))).withColumn("rel", relative(F.col("file"), F.col("prefix")))


def tree(rel_files: DataFrame) -> DataFrame:
    """(folder, file, rel): the closure of folders above each file; '' is the top. rel_files: file, rel."""
    parts = F.split("rel", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return rel_files.select(F.explode(folders).alias("folder"), "file", "rel")


def attention_rollup(rel_files: DataFrame, counts: DataFrame) -> DataFrame:
    """(folder, files, files_needing_attention), recursively."""
    held = tree(rel_files).join(counts.filter("attention > 0").select("file", F.lit(1).alias("a")), "file", "left")
    return held.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.count("a").alias("attention_files"))


def tree_order(rel_files: DataFrame) -> DataFrame:
    """(parent, entry, is_folder, place): folders before files; folders by code unit, files by locale."""
    parts = F.split("rel", "/")
    files = rel_files.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("parent"), F.element_at(parts, -1).alias("entry"), F.lit(False).alias("is_folder"))
    folders = tree(rel_files).select("folder").distinct().filter("folder <> ''")
    parts = F.split("folder", "/")
    folders = folders.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("parent"), F.element_at(parts, -1).alias("entry"), F.lit(True).alias("is_folder"))
    order = Window.partitionBy("parent").orderBy(F.desc("is_folder"), F.when(F.col("is_folder"), F.col("entry")), F.collate("entry", "UNICODE"), "entry")
    return folders.union(files).withColumn("place", F.row_number().over(order))


def search(rel_files: DataFrame, text: str) -> DataFrame:
    """Files whose path contains text in whatever case, by relative path."""
    return rel_files.filter(F.contains(F.lower("file"), F.lit(text.lower()))).orderBy("rel", "file")


def label(entry_raw: str = "raw", name: str = "imported_name") -> Column:
    return F.coalesce(F.when(F.col(entry_raw) != "", F.col(entry_raw)), F.when(F.col(name) != "", F.col(name)), F.lit("(dynamic)"))


def unresolved_list(unresolved: DataFrame) -> DataFrame:
    """Attention first, each with its label."""
    return classified(unresolved).withColumn("label", label()).withColumn("place", F.when(F.col("status") == "attention", 0).otherwise(1))


def node_view(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """Nodes with status, size and tooltip. stats: node and degrees; counts: file, attention, expected."""
    held = stats.join(counts.withColumnRenamed("file", "node"), "node", "left").fillna(0, ["attention", "expected"])
    status = F.when(F.col("attention") > 0, "attention").when(F.col("expected") > 0, "expected").otherwise("clean")
    name = short_name("node")
    need = F.when(F.col("attention") > 0, F.concat(F.col("attention").cast("string"), F.lit(" unresolved import"), F.when(F.col("attention") == 1, "").otherwise("s"), F.lit(" need attention")))
    fine = F.when(F.col("expected") > 0, F.concat(F.col("expected").cast("string"), F.lit(" stdlib/third-party import"), F.when(F.col("expected") == 1, "").otherwise("s"), F.lit(" (expected)")))
    height = F.lit(26.0) + F.least(F.lit(8.0), F.col("degree") * 1.2)
    width = F.least(F.lit(180.0), F.greatest(F.lit(64.0), F.length(name) * 6.5 + 20))
    return held.select("node", name.alias("label"), "in_degree", "out_degree", "degree", "attention", "expected", status.alias("status"), height.alias("height"), width.alias("width"), F.concat_ws(" — ", "node", need, fine).alias("tooltip"))
