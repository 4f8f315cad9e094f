"""Review decisions: their keys, their store, their application, what is left to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISION = "key string, decision string, file string, line int, raw string, imported_name string, resolved_file string, reason string"
REJECTED = "manually rejected during review"


def override_key() -> Column:
    """file:line:raw, and the imported name if there is one."""
    name = F.coalesce(F.col("imported_name"), F.lit(""))
    base = F.concat(F.coalesce("file", F.lit("")), F.lit(":"), F.coalesce("line", F.lit(-1)).cast("string"), F.lit(":"), F.coalesce("raw", F.lit("")))
    return F.when(name == "", base).otherwise(F.concat(base, F.lit(":"), name))


def decisions(entries: DataFrame, decision: str, resolved_file: Column | None = None, reason: Column | None = None) -> DataFrame:
    """Records of one decision on each entry: confirm, reject or manual."""
    none = F.lit(None).cast("string")
    own = F.col("resolved_file") if "resolved_file" in entries.columns else none
    target = none if decision == "reject" else resolved_file if decision == "manual" else F.coalesce(F.when(resolved_file != "", resolved_file), own) if resolved_file is not None else own
    why = F.coalesce(F.when(reason != "", reason), F.lit(REJECTED)) if decision == "reject" and reason is not None else F.lit(REJECTED) if decision == "reject" else none
    base = [F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(-1)).cast("int").alias("line"), F.coalesce("raw", F.lit("")).alias("raw"), F.col("imported_name")]
    return entries.select(override_key().alias("key"), F.lit(decision).alias("decision"), *base, target.alias("resolved_file"), why.alias("reason"))


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new decisions in place of old ones on the same key."""
    return store.join(new.select("key"), "key", "left_anti").unionByName(new.dropDuplicates(["key"]))


def apply(imports: DataFrame, unresolved: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imports, unresolved) after the decisions.

    Unresolved entries confirmed or given a target become imports; imports rejected go. All
    else stays: decisions on function edges, or to reject what is unresolved, change nothing.
    """
    chosen = store.select(F.col("key").alias("k"), "decision", F.col("resolved_file").alias("target"))
    open_ = unresolved.withColumn("k", override_key()).join(chosen, "k", "left")
    given = F.coalesce(F.col("decision").isin("confirm", "manual") & (F.col("target") != ""), F.lit(False))
    promoted = open_.filter(given).withColumn("resolved_file", F.col("target")).withColumn("resolution", F.concat(F.lit("override:"), "decision")).withColumn("reason", F.lit(None).cast("string")).drop("k", "decision", "target")
    still = open_.filter(~given).drop("k", "decision", "target")
    # a promoted entry has the key of its own confirmation, so no rejection can meet it
    kept = imports.withColumn("k", override_key()).join(chosen.filter("decision = 'reject'").select("k"), "k", "left_anti").drop("k")
    return kept.unionByName(promoted, allowMissingColumns=True), still


def missing_nodes(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Nodes, of null hash, for promoted entries whose file has none."""
    return imports.select("file").distinct().join(files, "file", "left_anti").withColumn("hash", F.lit(None).cast("string"))


def current_keys(*entries: DataFrame) -> DataFrame:
    out = None
    for e in entries:
        keys = (e if "imported_name" in e.columns else e.withColumn("imported_name", F.lit(None).cast("string"))).select(override_key().alias("key"))
        out = keys if out is None else out.union(keys)
    return out.distinct()


def orphans(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Decisions whose entry is gone."""
    return store.join(keys, "key", "left_anti")


def prune(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys, "key", "left_semi")


def ambiguous() -> Column:
    """Resolved entries that a person should look at."""
    return F.coalesce(F.col("resolution") == "name_inside_module", F.lit(False)) | F.coalesce(F.col("imported_name") == "*", F.lit(False))


def review_queue(imports: DataFrame, unresolved: DataFrame, function_edges: DataFrame) -> DataFrame:
    """Unresolved entries, ambiguous imports, unresolved function edges: all rows, by section."""
    parts = [unresolved, imports.filter(ambiguous()), function_edges.filter("resolved_file is null")]
    out = None
    for section, part in enumerate(parts, 1):
        part = part.withColumn("section", F.lit(section))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def pending(queue: DataFrame, store: DataFrame, show_all: bool = False) -> DataFrame:
    keyed = queue.withColumn("key", override_key())
    return keyed if show_all else keyed.join(store.select("key"), "key", "left_anti")


def shown(queue: DataFrame) -> DataFrame:
    """(key, line): each entry as the lines a reviewer sees; a line each for the fields it has."""
    part = lambda label, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(label), F.col(c).cast("string")))
    head = F.concat(F.coalesce("file", F.lit("None")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("None")))
    must = lambda label, c: F.concat(F.lit(label), F.coalesce(F.col(c), F.lit("None")))
    resolved = F.when(F.coalesce(F.col("resolved_file"), F.lit("")) != "", F.concat(F.lit("  resolved:  "), "resolved_file", F.lit(" ("), F.coalesce("resolution", F.lit("None")), F.lit(")")))
    lines = F.concat_ws("\n", head, must("  kind:      ", "kind"), must("  raw:       ", "raw"), part("  name:      ", "imported_name"), resolved, part("  note:      ", "note"), part("  reason:    ", "reason"))
    return queue.select(override_key().alias("key"), lines.alias("text"))
