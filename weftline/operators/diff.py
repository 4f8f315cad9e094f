"""What differs between two snapshots. Missing fields equal each other throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["file", "kind", "raw", "imported_name", "alias", "resolved_file"]
UNRESOLVED = ["file", "line", "raw", "imported_name"]


def edge_set(imports: DataFrame) -> DataFrame:
    """An edge's identity leaves its line out."""
    return imports.select(*EDGE).distinct()


def files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change) with change added, removed or changed. old, new: file, hash."""
    a, b = old.select("file", F.col("hash").alias("old_hash"), F.lit(1).alias("o")), new.select("file", F.col("hash").alias("new_hash"), F.lit(1).alias("n"))
    both = a.join(b, "file", "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed")
    return both.select("file", change.alias("change")).filter("change is not null")


def edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges added and removed, those of added and removed files included."""
    a, b = edge_set(old), edge_set(new)
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def _last(unresolved: DataFrame) -> DataFrame:
    newest = Window.partitionBy(*UNRESOLVED).orderBy(F.desc("ord"))
    return unresolved.withColumn("nth", F.row_number().over(newest)).filter("nth = 1").drop("nth")


def unresolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Unresolved entries added and removed; of equal keys the last entry stands for all."""
    a, b = _last(old), _last(new)

    def lacking(x: DataFrame, y: DataFrame, change: str) -> DataFrame:
        keys = y.select(*(F.col(c).alias(f"_{c}") for c in UNRESOLVED))
        same = F.lit(True)
        for c in UNRESOLVED:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return x.join(keys, same, "left_anti").withColumn("change", F.lit(change))

    return lacking(b, a, "added").unionByName(lacking(a, b, "removed"))


def report(file_changes: DataFrame, edge_changes: DataFrame, unresolved_changes: DataFrame) -> DataFrame:
    """(section, ord, line): the text report, to be read in that order.

    It has no line at all if nothing but removed unresolved entries differ.
    """
    quiet = file_changes.filter("change = 'changed'").join(edge_changes.select("file").distinct(), "file", "left_anti")
    parts = [
        (1, file_changes.filter("change = 'added'"), "Files added (%d):", "  + "),
        (2, file_changes.filter("change = 'removed'"), "Files removed (%d):", "  - "),
        (3, quiet, "Files changed, no import-level differences (%d):", "  ~ "),
    ]
    out = []
    for section, rows, title, mark in parts:
        out.append(rows.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(section).alias("section"), F.lit("").alias("ord"), F.format_string(title, "n").alias("line")))
        out.append(rows.select(F.lit(section).alias("section"), F.concat(F.lit("1"), "file").alias("ord"), F.concat(F.lit(mark), "file").alias("line")))
    show = lambda c: F.coalesce(F.col(c), F.lit("None"))
    out.append(edge_changes.limit(1).select(F.lit(4).alias("section"), F.lit("").alias("ord"), F.lit("Import changes:").alias("line")))
    out.append(edge_changes.select("file").distinct().select(F.lit(4).alias("section"), F.concat(F.lit("1"), "file").alias("ord"), F.concat(F.lit("  "), "file").alias("line")))
    mark = F.when(F.col("change") == "added", "+").otherwise("-")
    text = F.concat(F.lit("    "), mark, F.lit(" "), show("kind"), F.lit(" "), show("raw"), F.lit(" ("), show("imported_name"), F.lit(")"))
    place = F.concat(F.lit("1"), "file", F.lit("\u0001"), "change", F.lit("\u0001"), *(c for n in EDGE[1:] for c in (show(n), F.lit("\u0001"))))
    out.append(edge_changes.select(F.lit(4).alias("section"), place.alias("ord"), text.alias("line")))
    new = unresolved_changes.filter("change = 'added'")
    out.append(new.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(5).alias("section"), F.lit("").alias("ord"), F.format_string("New unresolved imports (%d):", "n").alias("line")))
    out.append(new.select(F.lit(5).alias("section"), F.concat(F.lit("1"), show("file"), F.lit("\u0001"), F.lpad(F.col("line").cast("string"), 10, "0"), show("raw")).alias("ord"), F.concat(F.lit("  ! "), show("file"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), show("raw")).alias("line")))
    any_change = file_changes.select(F.lit(1)).union(edge_changes.select(F.lit(1))).union(unresolved_changes.select(F.lit(1)))
    none = any_change.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    out.append(none.select(F.lit(6).alias("section"), F.lit("").alias("ord"), F.lit("No differences.").alias("line")))
    lines = out[0]
    for part in out[1:]:
        lines = lines.unionByName(part)
    return lines
