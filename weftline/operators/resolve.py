"""Facts to edges: a module index, import resolution, and references traced as of their place.

Targets are looked for among all paths of the tree, scanned or not, directories included. A
module's file is the first of module file, package initialiser and bare directory in the first
source root that has any; that choice is made once per key, in the index, and imports join it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.lineage import maybe_broadcast

# Fixed texts and kinds of the entries.
STDLIB = "stdlib or third-party (not found in project)"
NOT_FOUND = "not found in project (stdlib/third-party)"
NO_WILDCARD = "wildcard target not found in project (stdlib/third-party)"
DYNAMIC = "dynamic import: target is a runtime value, not statically resolvable"
NOT_SIMPLE = "argument is not a simple name/attribute reference (e.g. a lambda or call expression) — cannot statically resolve"
NO_DEPENDENCY, NO_CALLABLE = "no dependency callable argument", "no callable argument"
NAMESPACE = "target is a namespace package; name not verified"
BY_ALL = "wildcard import: only names listed in __all__ are pulled in"
BY_PUBLIC = "wildcard import: module has no __all__, so all public (non-underscore) top-level names are pulled in"

ENTRY = ["file", "ord", "kind", "raw", "imported_name", "alias", "line", "resolved_file", "resolution", "note", "reason", "exported_names"]


def source_roots(spark: SparkSession, paths: DataFrame, root: str) -> DataFrame:
    """(rank, root): src below the project if that is a directory, then the project."""
    src = paths.filter((F.col("path") == f"{root}/src") & F.col("is_dir")).limit(1).select(F.lit(0).alias("rank"), F.lit(f"{root}/src").alias("root"))
    return src.union(spark.createDataFrame([(1, root)], "rank int, root string"))


def _below(path: Column, root: Column) -> Column:
    return path.startswith(F.concat(root, F.lit("/")))


def _from(path: Column, root: Column) -> Column:
    return path.substr(F.length(root) + 2, F.length(path))


def module_index(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, target, is_dir): the file of each slash-joined module name. paths: path, is_dir."""
    held = paths.join(F.broadcast(roots), _below(F.col("path"), F.col("root"))).withColumn("rel", _from(F.col("path"), F.col("root")))
    plain = held.filter("not is_dir").filter(F.col("rel").endswith(".py")).withColumn("key", F.expr("substring(rel, 1, length(rel) - 3)"))
    packages = plain.filter(F.col("key").endswith("/__init__")).withColumn("key", F.expr("substring(key, 1, length(key) - 9)"))
    rows = plain.withColumn("prio", F.lit(0)).unionByName(packages.withColumn("prio", F.lit(1))).unionByName(held.filter("is_dir").withColumn("key", F.col("rel")).withColumn("prio", F.lit(2)))
    best = rows.filter("key <> ''").groupBy("key").agg(F.min(F.struct("rank", "prio", "path", "is_dir")).alias("b"))
    return best.select("key", F.col("b.path").alias("target"), F.col("b.is_dir").alias("is_dir"))


def module_parts(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(file, parts): a file's own dotted name in the first root that contains it."""
    held = files.select("file").join(F.broadcast(roots), _below(F.col("file"), F.col("root")))
    first = held.groupBy("file").agg(F.min(F.struct("rank", "root")).alias("r"))
    parts = F.split(F.regexp_replace(_from(F.col("file"), F.col("r.root")), r"\.[^./]*$", ""), "/")
    return first.select("file", F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts).alias("parts"))


def _base(parts: Column, level: Column, module: Column) -> Column:
    """Parts that a from-import starts from; too many dots end at the root."""
    own = F.when(F.coalesce(module, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(module, r"\."))
    package = F.slice(parts, 1, F.greatest(F.size(parts) - level, F.lit(0)))
    return F.when(level == 0, own).otherwise(F.concat(package, own))


def exports(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((target, name) that a module offers, (target, exported_names, by_all) for wildcards)."""
    names = facts.filter("fact in ('bind', 'all', 'has_all')").select(F.col("file").alias("target"), "fact", "ord", "level", "name")
    lists = names.groupBy("target").agg(
        F.max(F.when(F.col("fact") == "has_all", F.col("level"))).alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("fact") == "all", F.struct("ord", "level", "name")))).alias("listed"),
        F.collect_set(F.when((F.col("fact") == "bind") & (F.col("name") != "*"), F.col("name"))).alias("bound"),
    ).withColumn("by_all", F.col("last").isNotNull())
    # the last __all__ counts
    listed = F.transform(F.filter("listed", lambda x: x["level"] == F.col("last")), lambda x: x["name"])
    public = F.sort_array(F.filter("bound", lambda x: ~x.startswith("_")))
    offered = lists.select("target", F.explode(F.array_distinct(F.when(F.col("by_all"), listed).otherwise(F.col("bound")))).alias("name"))
    return offered, lists.select("target", F.when(F.col("by_all"), listed).otherwise(public).alias("exported_names"), "by_all")


def imports(facts: DataFrame, parts: DataFrame, index: DataFrame) -> DataFrame:
    """Every import as an entry, resolved or with a reason. index should be small or left to a shuffle."""
    none = F.lit(None).cast("string")
    rows = facts.filter("fact = 'import'").select("file", "ord", "top_level", "kind", "raw", "module", "level", F.col("name").alias("imported_name"), "alias", "line").join(parts, "file", "left")
    base = F.array_join(_base(F.col("parts"), F.col("level"), F.col("module")), "/")
    whole = F.translate(F.col("raw"), ".", "/")
    rows = rows.withColumn("base_key", F.when(F.col("kind") == "import", whole).otherwise(base))
    rows = rows.withColumn("sub_key", F.when((F.col("kind") == "from_import") & (F.col("imported_name") != "*"), F.when(F.col("base_key") == "", F.col("imported_name")).otherwise(F.concat_ws("/", "base_key", "imported_name"))))
    index = maybe_broadcast(index)
    rows = rows.join(index.select(F.col("key").alias("base_key"), F.col("target").alias("base_target"), F.col("is_dir").alias("base_dir")), "base_key", "left")
    rows = rows.join(index.select(F.col("key").alias("sub_key"), F.col("target").alias("sub_target")), "sub_key", "left")
    offered, lists = exports(facts)
    rows = rows.join(offered.select(F.col("target").alias("base_target"), F.col("name").alias("imported_name"), F.lit(True).alias("offered")), ["base_target", "imported_name"], "left")
    rows = rows.join(lists.select(F.col("target").alias("base_target"), F.col("exported_names").alias("pulled"), "by_all"), "base_target", "left")
    found, is_star, is_from = F.col("base_target").isNotNull(), F.col("imported_name") == "*", F.col("kind") == "from_import"
    star, named = is_from & is_star, is_from & ~is_star
    inside = found & (F.col("base_dir") | F.coalesce("offered", F.lit(False)))
    target = F.when(named & F.col("sub_target").isNotNull(), F.col("sub_target")).when(named, F.when(inside, F.col("base_target"))).otherwise(F.col("base_target"))
    resolution = F.when(named & F.col("sub_target").isNotNull(), "submodule").when(named & inside, "name_inside_module")
    note = F.when(star & found, F.when(F.coalesce("by_all", F.lit(False)), BY_ALL).otherwise(BY_PUBLIC)).when(named & F.col("sub_target").isNull() & found & F.col("base_dir"), NAMESPACE)
    absent = F.concat(F.lit("'"), "imported_name", F.lit("' not found among top-level names of "), "base_target", F.lit(" (checked __all__ if present, else module body)"))
    reason = F.when(target.isNotNull(), none).when(F.col("kind") == "import", STDLIB).when(star, NO_WILDCARD).when(found, absent).otherwise(NOT_FOUND)
    pulled = F.when(star & found, F.coalesce("pulled", F.array().cast("array<string>")))
    return rows.select("file", "ord", "top_level", "kind", "raw", "imported_name", "alias", "line", target.alias("resolved_file"), resolution.alias("resolution"), note.alias("note"), reason.alias("reason"), pulled.alias("exported_names"))


def bindings(entries: DataFrame) -> DataFrame:
    """(file, ord, top_level, bound, target): names that imports bind; a wildcard binds what it pulls in."""
    single = F.when(F.col("kind") == "import", F.coalesce("alias", F.element_at(F.split("raw", r"\."), 1))).when(F.col("imported_name") != "*", F.coalesce("alias", "imported_name"))
    bound = F.when(single.isNotNull(), F.array(single)).otherwise(F.coalesce("exported_names", F.array().cast("array<string>")))
    return entries.select("file", "ord", "top_level", F.explode(bound).alias("bound"), F.col("resolved_file").alias("target"))


def as_of(refs: DataFrame, bound: DataFrame) -> DataFrame:
    """refs (file, ord, ref_name, …) with target: that of the last binding of the name before the reference, null if that has none.

    One sort of references and bindings together; no reference meets more than one binding.
    """
    none = F.lit(None)
    left = refs.withColumn("_binding", F.lit(1)).withColumn("_bound", none.cast(f"struct<target:{dict(bound.dtypes)['target']}>"))
    rest = [none.cast(t).alias(c) for c, t in refs.dtypes if c not in ("file", "ord", "ref_name")]
    right = bound.select("file", "ord", F.col("bound").alias("ref_name"), *rest, F.lit(2).alias("_binding"), F.struct("target").alias("_bound"))
    # a binding in the reference's own place comes after it
    before = Window.partitionBy("file", "ref_name").orderBy("ord", "_binding").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn("_last", F.last("_bound", ignorenulls=True).over(before))
    return both.filter("_binding = 1").select(*refs.columns, F.col("_last.target").alias("target"))


def references(facts: DataFrame, bound: DataFrame) -> DataFrame:
    """Dependency and background-task edges: imported name, then a definition of the same file, then unresolved."""
    refs = facts.filter("fact = 'ref' and kind <> 'dynamic_import'").select("file", "ord", "kind", "raw", "line", "has_arg", "ref_name")
    traced = as_of(refs, bound)
    local = facts.filter("fact = 'top_def'").select("file", F.col("name").alias("ref_name"), F.lit(True).alias("local")).distinct()
    traced = traced.join(local, ["file", "ref_name"], "left")
    here = F.coalesce("local", F.lit(False))
    target = F.when(F.col("target").isNotNull(), F.col("target")).when(here, F.col("file"))
    resolution = F.when(F.col("target").isNotNull(), "imported_name").when(here, "same_file")
    absent = F.concat(F.lit("'"), "ref_name", F.lit("' not found among this file's imports or top-level definitions"))
    bare = F.when(F.col("kind") == "fastapi_dependency", NO_DEPENDENCY).otherwise(NO_CALLABLE)
    reason = F.when(target.isNotNull(), F.lit(None)).when(~F.col("has_arg"), bare).when(F.col("ref_name").isNull(), NOT_SIMPLE).otherwise(absent)
    return traced.select("file", "ord", "kind", "raw", "line", target.alias("resolved_file"), resolution.alias("resolution"), reason.alias("reason"))


def dynamic(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'ref' and kind = 'dynamic_import'").select("file", "ord", "kind", "raw", "line", F.lit(DYNAMIC).alias("reason"))


def module_graph(facts: DataFrame, files: DataFrame, paths: DataFrame, root: str) -> dict[str, DataFrame]:
    """imports, unresolved, function_edges (and all entries, for call resolution).

    files: file (the scanned ones); facts may cover more, as any file of the tree can be a target.
    """
    spark = facts.sparkSession
    roots = source_roots(spark, paths, root)
    index = module_index(paths, roots)
    scanned = facts.join(files.select("file"), "file", "left_semi")
    own = scanned.filter("fact in ('import', 'ref', 'top_def')").unionByName(facts.filter("fact in ('bind', 'all', 'has_all')"))
    entries = imports(own, module_parts(files, roots), index)
    edges = references(own, bindings(entries))
    return {
        "entries": entries,
        "imports": entries.filter("resolved_file is not null").select(*ENTRY),
        "unresolved": entries.filter("resolved_file is null").select(*ENTRY).unionByName(dynamic(own), allowMissingColumns=True),
        "function_edges": edges,
    }
