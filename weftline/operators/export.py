"""Graphs as text: Graphviz lines and the nested JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed lines of the document.
OPENING = ["digraph module_graph {", '  rankdir="LR";', "  node [shape=box];"]
UNRESOLVED_NODE = '  "<unresolved>" [shape=octagon, color=red, label="unresolved imports"];'


def _escaped(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit('\\"'))


def dot_lines(files: DataFrame, imports: DataFrame, root: str, unresolved: DataFrame | None = None) -> DataFrame:
    """(section, place, line), to be read in that order. Parallel edges stay; only quotes are escaped.

    files: file; imports: file, ord, resolved_file; unresolved: file, ord, raw, imported_name.
    """
    spark = files.sparkSession
    fixed = [(0, str(k), line) for k, line in enumerate(OPENING)] + [(9, "", "}")] + ([(3, "", UNRESOLVED_NODE)] if unresolved is not None else [])
    frame = spark.createDataFrame(fixed, "section int, place string, line string")
    targets = imports.filter("resolved_file is not null and resolved_file <> ''")
    nodes = files.select("file").union(targets.select(F.col("resolved_file").alias("file"))).distinct()
    base = root.rstrip("/") + "/"
    label = F.when(F.col("file").startswith(base), F.col("file").substr(F.lit(len(base) + 1), F.length("file"))).otherwise(F.col("file"))
    place = lambda: F.concat("file", F.lit("\u0001"), F.lpad(F.col("ord").cast("string"), 10, "0"))
    out = frame.union(nodes.select(F.lit(1), F.col("file"), F.concat(F.lit('  "'), _escaped(F.col("file")), F.lit('" [label="'), _escaped(label), F.lit('"];'))))
    out = out.union(targets.select(F.lit(2), place(), F.concat(F.lit('  "'), _escaped(F.col("file")), F.lit('" -> "'), _escaped(F.col("resolved_file")), F.lit('";'))))
    if unresolved is not None:
        named = F.coalesce(F.when(F.col("imported_name") != "", F.col("imported_name")), "raw", F.lit("?"))
        rows = unresolved.filter("file is not null and file <> ''")
        out = out.union(rows.select(F.lit(4), place(), F.concat(F.lit('  "'), _escaped(F.col("file")), F.lit('" -> "<unresolved>" [color=red, fontcolor=red, label="'), _escaped(named), F.lit('"];'))))
    return out


def entry_json() -> Column:
    """An entry as JSON: absent fields left out, but an import's alias shown even if null."""
    rest = F.to_json(F.struct("kind", "raw", "imported_name", "line", "resolved_file", "resolution", "note", "reason", "exported_names"))
    alias = F.to_json(F.struct("alias"), {"ignoreNullFields": "false"})
    both = F.concat(F.regexp_replace(alias, r"\}$", ","), F.regexp_replace(rest, r"^\{", ""))
    return F.when(F.col("kind").isin("import", "from_import"), both).otherwise(rest)


def nested(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, hash, imports): each scanned file with its ordered entries."""
    fields = [c for c in imports.columns if c not in ("file", "ord")]
    lists = imports.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("e")))).alias("x"))
    return files.join(lists.select("file", F.transform("x", lambda v: v["e"]).alias("imports")), "file", "left")
