"""Queries over the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import context, diff, export, graph, incremental, overrides, resolve, rollup, traverse
from weftline.plans import corpus, key_graph, page_links
from weftline.plans.key_graph import EDGES_SQL, NODES_SQL, table
from weftline.streaming import jobs as job_table

#: Nodes whose dependents are asked for: a region and a supplier.
CHANGED = ["r:0", "s:3"]
_CHANGED_SQL = ", ".join(f"('{c}')" for c in CHANGED)

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_edges(key_graph.raw_edges(spark, d))


def _changed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CHANGED], "seed string")


# Edges, degrees, hubs

@_add("distinct_edges", EDGES_SQL)
def _(spark, d):
    return _edges(spark, d)


@_add("forward_adjacency", f"select src, count(*)::bigint as targets, min(dst) as first, max(dst) as last from ({EDGES_SQL}) group by src")
def _(spark, d):
    out = graph.outgoing(_edges(spark, d))
    return out.select(F.col("node").alias("src"), F.size("targets").cast("long").alias("targets"), F.array_min("targets").alias("first"), F.array_max("targets").alias("last"))


@_add("reverse_adjacency", f"select dst as src, src as dst from ({EDGES_SQL})")
def _(spark, d):
    return traverse.reverse(_edges(spark, d))


_DEGREES = f"""with e as ({EDGES_SQL}), n as ({NODES_SQL}), o as (select src, count(*) as c from e group by src), i as (select dst, count(*) as c from e group by dst),
deg as (select node, coalesce(i.c, 0)::bigint as in_degree, coalesce(o.c, 0)::bigint as out_degree, (coalesce(i.c, 0) + coalesce(o.c, 0))::bigint as degree from n left join o on node = src left join i on node = dst)
"""


def _degrees(spark, d):
    return graph.degrees(key_graph.nodes(spark, d), _edges(spark, d))


@_add("degrees", _DEGREES + "select * from deg")
def _(spark, d):
    return _degrees(spark, d)


@_add("max_degree", _DEGREES + "select coalesce(max(degree), 0)::bigint as max_degree from deg")
def _(spark, d):
    return graph.max_degree(_degrees(spark, d))


@_add("hubs_top5", _DEGREES + "select * from deg where degree > 0 order by degree desc, node limit 5")
def _(spark, d):
    return graph.hubs(_degrees(spark, d))


@_add("neighborhood", f"with e as ({EDGES_SQL}), c(node) as (values {_CHANGED_SQL}) select node from c union select dst from e where src in (from c) union select src from e where dst in (from c)")
def _(spark, d):
    return graph.neighbourhood(_edges(spark, d), _changed(spark).withColumnRenamed("seed", "node"))


@_add("neighborhood_edges", f"with e as ({EDGES_SQL}), c(node) as (values {_CHANGED_SQL}), n as (select node from c union select dst from e where src in (from c) union select src from e where dst in (from c)) select src, dst from e where src in (from n) and dst in (from n)")
def _(spark, d):
    return graph.highlighted(_edges(spark, d), _changed(spark).withColumnRenamed("seed", "node"))


# Traversal

def _reach_sql(seeds: str, here: str, there: str, depth: int | None = None) -> str:
    bound = f"and depth < {depth}" if depth else ""
    return f"""with recursive e as ({EDGES_SQL}), s as ({seeds}), r as (select seed, seed as node, 0 as depth from s union select r.seed, e.{there}, r.depth + 1 from r join e on e.{here} = r.node where true {bound}),
found as (select seed, node, min(depth)::int as depth from r where node <> seed group by seed, node)
"""


_SEEDS_SQL = f"select seed from (values {_CHANGED_SQL}) v(seed)"


@_add("callers_depth", _reach_sql(_SEEDS_SQL, "dst", "src") + "select * from found")
def _(spark, d):
    return traverse.callers(_edges(spark, d), _changed(spark))


@_add("callers_direct", _reach_sql(_SEEDS_SQL, "dst", "src", 1) + "select * from found")
def _(spark, d):
    return traverse.callers(_edges(spark, d), _changed(spark), 1)


@_add("callees_depth", _reach_sql("select 's:' || s_suppkey as seed from supplier union all select 'c:' || c_custkey from customer", "src", "dst") + "select * from found")
def _(spark, d):
    seeds = key_graph.nodes(spark, d).filter(F.col("node").rlike("^[cs]:")).withColumnRenamed("node", "seed")
    return traverse.callees(_edges(spark, d), seeds)


@_add("callees_bounded", _reach_sql("select 'o:' || o_orderkey as seed from orders", "src", "dst", 2) + "select * from found")
def _(spark, d):
    return traverse.callees(_edges(spark, d), key_graph.nodes(spark, d).filter("node like 'o:%'").withColumnRenamed("node", "seed"), 2)


@_add("blast_radius", _reach_sql(_SEEDS_SQL, "dst", "src") + "select seed, node, depth, depth = 1 as direct from found")
def _(spark, d):
    return traverse.blast_radius(_edges(spark, d), _changed(spark))


@_add("blast_union", _reach_sql(_SEEDS_SQL, "dst", "src") + "select distinct node from found")
def _(spark, d):
    return traverse.blast_union(_edges(spark, d), _changed(spark))


@_add("blast_lists", _reach_sql(_SEEDS_SQL, "dst", "src") + "select seed, count(*) filter (depth = 1)::bigint as direct, count(*)::bigint as total, min(node) as first, max(node) as last from found group by seed")
def _(spark, d):
    lists = traverse.blast_lists(_edges(spark, d), _changed(spark))
    return lists.select("seed", F.size("direct_callers").cast("long").alias("direct"), F.size("all_callers").cast("long").alias("total"), F.array_min("all_callers").alias("first"), F.array_max("all_callers").alias("last"))


# Snapshots: documents as files, before and after a source went, one came and a language was edited

def _snapshots(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), "text", "lang", "source")
    old = docs.filter("source <> 'src3'").select("file", F.sha2("text", 256).alias("hash"))
    return old, docs.filter("source <> 'src5'").select("file", F.sha2(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))


_SNAPSHOTS_SQL = "with old as (select 'd' || doc_id as file, sha256(text) as hash from documents where source <> 'src3'), new as (select 'd' || doc_id as file, sha256(case when lang = 'fr' then text || '!' else text end) as hash from documents where source <> 'src5') "


@_add("diff_files", _SNAPSHOTS_SQL + "select coalesce(o.file, n.file) as file, case when o.file is null then 'added' when n.file is null then 'removed' else 'changed' end as change from old o full join new n on o.file = n.file where o.hash is distinct from n.hash")
def _(spark, d):
    return diff.files(*_snapshots(spark, d))


@_add("incremental_stats", _SNAPSHOTS_SQL + "select count(*) filter (o.hash = n.hash)::bigint as cached, count(*) filter (n.file is not null and o.hash is distinct from n.hash)::bigint as rescanned, count(*) filter (n.file is null)::bigint as removed_from_cache from old o full join new n on o.file = n.file")
def _(spark, d):
    old, new = _snapshots(spark, d)
    return incremental.stats(new, old)


@_add("incremental_rescan", _SNAPSHOTS_SQL + "select n.file, n.hash from new n left join old o on o.file = n.file and o.hash = n.hash where o.file is null")
def _(spark, d):
    old, new = _snapshots(spark, d)
    return incremental.split(new, old)[1]


def _link_snapshots(spark, d):
    e = page_links.entries(spark, d)
    new = e.filter(~F.contains("url", F.lit("example.org"))).withColumn("alias", F.when(F.length("raw") % 11 == 0, None).otherwise(F.col("alias"))).withColumn("line", F.when(F.length("raw") % 13 == 0, F.col("line") + 1).otherwise(F.col("line")).cast("int"))
    return e.filter(F.col("url").startswith("https")), new


_LINKS_SQL = f"with {page_links.ENTRIES_SQL.strip()}, old as (select * from ent where url like 'https%'), new as (select * replace (case when length(raw) % 11 = 0 then null else alias end as alias, case when length(raw) % 13 = 0 then line + 1 else line end as line) from ent where not contains(url, 'example.org')) "
_EDGE = ", ".join(diff.EDGE)


@_add("diff_edges", _LINKS_SQL + f", a as (select {_EDGE} from old where resolved_file is not null), b as (select {_EDGE} from new where resolved_file is not null) select *, 'added' as change from (from b except from a) union all select *, 'removed' from (from a except from b)")
def _(spark, d):
    old, new = _link_snapshots(spark, d)
    return diff.edges(old.filter("resolved_file is not null"), new.filter("resolved_file is not null"))


_UNRES = ", ".join(diff.UNRESOLVED)


@_add("diff_unresolved", _LINKS_SQL + f", a as (select distinct {_UNRES} from old where resolved_file is null), b as (select distinct {_UNRES} from new where resolved_file is null) select *, 'added' as change from (from b except from a) union all select *, 'removed' from (from a except from b)")
def _(spark, d):
    old, new = _link_snapshots(spark, d)
    return diff.unresolved(old.filter("resolved_file is null"), new.filter("resolved_file is null")).select(*diff.UNRESOLVED, "change")


@_add("diff_report", None)
def _(spark, d):
    old, new = _link_snapshots(spark, d)
    files = [x.groupBy("file").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("raw")), "\n"), 256).alias("hash")) for x in (old, new)]
    resolved, unresolved = (old.filter("resolved_file is not null"), new.filter("resolved_file is not null")), (old.filter("resolved_file is null"), new.filter("resolved_file is null"))
    return diff.report(diff.files(*files), diff.edges(*resolved), diff.unresolved(*unresolved))


# Overrides and review

def _entries(spark, d):
    e = page_links.entries(spark, d).drop("url")
    return e.filter("resolved_file is not null"), e.filter("resolved_file is null"), page_links.store(e)


_STORE_SQL = f"with {page_links.STORE_SQL.strip()} "


@_add("override_keys", _STORE_SQL + "select distinct key from keyed")
def _(spark, d):
    imports, unresolved, _store = _entries(spark, d)
    return overrides.current_keys(imports, unresolved)


@_add("override_store", _STORE_SQL + "select key, decision, target as resolved_file from store")
def _(spark, d):
    return _entries(spark, d)[2].select("key", "decision", "resolved_file")


_GIVEN = "coalesce(s.decision in ('confirm', 'manual') and s.target <> '', false)"


@_add("override_apply", _STORE_SQL + f"""select k.file, k.ord, k.raw, k.resolved_file, k.resolution from keyed k left join store s using (key) where k.resolved_file is not null and s.decision is distinct from 'reject'
 union all select k.file, k.ord, k.raw, s.target, 'override:' || s.decision from keyed k join store s using (key) where k.resolved_file is null and {_GIVEN}""")
def _(spark, d):
    return overrides.apply(*_entries(spark, d))[0].select("file", "ord", "raw", "resolved_file", "resolution")


@_add("override_unresolved", _STORE_SQL + f"select k.file, k.ord, k.raw, k.reason from keyed k left join store s using (key) where k.resolved_file is null and not {_GIVEN}")
def _(spark, d):
    return overrides.apply(*_entries(spark, d))[1].select("file", "ord", "raw", "reason")


@_add("override_orphans", _STORE_SQL + "select key, decision from store where key not in (select key from keyed)")
def _(spark, d):
    imports, unresolved, store = _entries(spark, d)
    return overrides.orphans(store, overrides.current_keys(imports, unresolved)).select("key", "decision")


@_add("override_prune", _STORE_SQL + "select key, decision from store where key in (select key from keyed)")
def _(spark, d):
    imports, unresolved, store = _entries(spark, d)
    return overrides.prune(store, overrides.current_keys(imports, unresolved)).select("key", "decision")


def _queue(spark, d):
    imports, unresolved, store = _entries(spark, d)
    return overrides.review_queue(imports, unresolved, _aliased(imports, unresolved)), store


def _aliased(imports, unresolved):
    """The links with an alias, which stand for function edges."""
    return imports.union(unresolved).filter("alias is not null")


_QUEUE_SQL = """, queued as (select case when resolved_file is null then 1 else 2 end as section, file, ord, raw, key from keyed where resolved_file is null or coalesce(resolution = 'name_inside_module', false) or coalesce(imported_name = '*', false)
union all select 3, file, ord, raw, key from keyed where resolved_file is null and alias is not null) select section, file, ord, raw{} from queued"""


@_add("review_queue", _STORE_SQL + _QUEUE_SQL.format(""))
def _(spark, d):
    return _queue(spark, d)[0].select("section", "file", "ord", "raw")


@_add("review_pending", _STORE_SQL + _QUEUE_SQL.format(", key") + " where key not in (select key from store)")
def _(spark, d):
    return overrides.pending(*_queue(spark, d)).select("section", "file", "ord", "raw", "key")


@_add("review_text", None)
def _(spark, d):
    queue = _queue(spark, d)[0].withColumn("note", F.lit(None).cast("string"))
    return overrides.shown(queue)


# Classification, paths, roll-ups

_EXPECTED = "regexp_matches(coalesce(reason, ''), '(?i)stdlib|third-party')"


@_add("unresolved_classify", _STORE_SQL + f"select file, ord, raw, case when {_EXPECTED} then 'expected' else 'attention' end as status, coalesce(nullif(raw, ''), nullif(imported_name, ''), '(dynamic)') as label from keyed where resolved_file is null")
def _(spark, d):
    return rollup.unresolved_list(_entries(spark, d)[1]).select("file", "ord", "raw", "status", "label")


_COUNTS = f"counts as (select file, count(*) filter (not {_EXPECTED})::bigint as attention, count(*) filter ({_EXPECTED})::bigint as expected from keyed where resolved_file is null group by file)"


@_add("unresolved_counts", f"with {page_links.STORE_SQL.strip()}, {_COUNTS} select * from counts")
def _(spark, d):
    return rollup.counts_per_file(_entries(spark, d)[1])


def _urls(spark, d):
    return table(spark, d, "pages").select(F.col("url").alias("file")).distinct()


_PREFIX_SQL = r"""f as (select distinct url as file from pages), p as (select file, regexp_split_to_array(file, '[\\/]') as parts from f),
x as (select unnest(parts[1:len(parts) - 1]) as part, generate_subscripts(parts[1:len(parts) - 1], 1) as pos from p),
a as (select pos, part from (select pos, count(*) as n, min(part) as part, max(part) as hi from x group by pos) where n = (select count(*) from f) and part = hi),
ok as (select pos, part, row_number() over (order by pos) as k from a),
pre as (select coalesce(string_agg(part, '/' order by pos), '') as prefix from ok where pos = k),
rel as (select file, case when prefix <> '' and starts_with(file, prefix || '/') then substr(file, length(prefix) + 2) else file end as rel from f, pre)
"""


@_add("common_prefix", f"with {_PREFIX_SQL.strip()} select prefix from pre")
def _(spark, d):
    return rollup.common_prefix(_urls(spark, d))


@_add("relative_path", f"with {_PREFIX_SQL.strip()} select file, rel from rel")
def _(spark, d):
    return rollup.relative_paths(_urls(spark, d)).select("file", "rel")


@_add("short_name", r"select distinct url as file, regexp_split_to_array(url, '[\\/]')[-1] as name from pages")
def _(spark, d):
    return _urls(spark, d).select("file", rollup.short_name("file").alias("name"))


def _site(spark, d):
    """Pages as files below their host, with counts of links that resolve or don't."""
    e = page_links.entries(spark, d)
    rel = F.regexp_replace("url", "^[a-z]+://", "")
    counts = rollup.counts_per_file(e.filter("resolved_file is null").withColumn("file", rel))
    return table(spark, d, "pages").select(rel.alias("file")).distinct().withColumn("rel", F.col("file")), counts


_SITE_SQL = f"""{page_links.ENTRIES_SQL.strip()}, site as (select distinct regexp_replace(url, '^[a-z]+://', '') as file from pages),
need as (select distinct regexp_replace(url, '^[a-z]+://', '') as file from ent where resolved_file is null and not {_EXPECTED}),
t as (select file, string_split(file, '/') as parts from site), closure as (select array_to_string(parts[:n - 1], '/') as folder, file from (select file, parts, unnest(range(1, len(parts) + 1)) as n from t))
"""


@_add("path_tree", f"with {_SITE_SQL.strip()} select folder, file from closure")
def _(spark, d):
    return rollup.tree(_site(spark, d)[0]).select("folder", "file")


@_add("path_rollup", f"with {_SITE_SQL.strip()} select folder, count(*)::bigint as files, count(need.file)::bigint as attention_files from closure left join need using (file) group by folder")
def _(spark, d):
    return rollup.attention_rollup(*_site(spark, d))


@_add("path_order", None)
def _(spark, d):
    return rollup.tree_order(_site(spark, d)[0])


@_add("file_search", f"with {_PREFIX_SQL.strip()} select file, rel from rel where contains(lower(file), 'page')")
def _(spark, d):
    return rollup.search(rollup.relative_paths(_urls(spark, d)).select("file", "rel"), "PAGE")


_NODE_VIEW = f"""{_STORE_SQL.strip()}, e as (select distinct file as src, resolved_file as dst from keyed where resolved_file is not null), n as (select file as node from keyed union select dst from e),
ends as (select src as node from e union all select dst from e), held as (select file, count(*) filter (not {_EXPECTED}) as attention, count(*) filter ({_EXPECTED}) as expected from keyed where resolved_file is null group by file),
v as (select n.node, (select count(*) from ends where ends.node = n.node)::bigint as degree, coalesce(attention, 0) as attention, coalesce(expected, 0) as expected, length(regexp_extract(n.node, '[^/\\\\]*$')) as long from n left join held on file = n.node)
select node, degree, case when attention > 0 then 'attention' when expected > 0 then 'expected' else 'clean' end as status, 26.0::double + least(8.0, degree * 1.2)::double as height, least(180.0, greatest(64.0, long * 6.5 + 20))::double as width,
concat_ws(' — ', node, case when attention > 0 then attention || ' unresolved import' || case when attention = 1 then '' else 's' end || ' need attention' end, case when expected > 0 then expected || ' stdlib/third-party import' || case when expected = 1 then '' else 's' end || ' (expected)' end) as tooltip from v
"""


@_add("node_view", _NODE_VIEW)
def _(spark, d):
    imports, unresolved, _store = _entries(spark, d)
    edges = graph.distinct_edges(imports.select(F.col("file").alias("src"), F.col("resolved_file").alias("dst")))
    nodes = imports.select(F.col("file").alias("node")).union(unresolved.select("file")).union(edges.select("dst")).distinct()
    return rollup.node_view(graph.degrees(nodes, edges), rollup.counts_per_file(unresolved)).select("node", "degree", "status", "height", "width", "tooltip")


@_add("graph_summary", _STORE_SQL + f", e as (select distinct file, resolved_file from keyed where resolved_file is not null) select (select count(*) from pages)::bigint as files, (select count(*) from e)::bigint as edges, (select count(*) from keyed where resolved_file is null and not {_EXPECTED})::bigint as attention, (select count(*) from keyed where alias is not null)::bigint as function_edges")
def _(spark, d):
    imports, unresolved, _store = _entries(spark, d)
    edges = graph.distinct_edges(imports.select(F.col("file").alias("src"), F.col("resolved_file").alias("dst")))
    return graph.summary(table(spark, d, "pages").select("page_id"), edges, unresolved, _aliased(imports, unresolved))


# Context

_ROLES = f"""with recursive e as ({EDGES_SQL}), s as ({_SEEDS_SQL}),
up as (select seed as node, 0 as depth from s union select e.src, up.depth + 1 from up join e on e.dst = up.node), down as (select seed as node, 0 as depth from s union select e.dst, down.depth + 1 from down join e on e.src = down.node),
c as (select node, 1 as k, depth from up where depth > 0 and node not in (from s) union all select node, 2, depth from down where depth > 0 and node not in (from s) union all select seed, 0, 0 from s),
m as (select node, min(k) as k from c group by node)
select node, m.k::int as role_rank, case m.k when 0 then 'changed' when 1 then 'caller' else 'callee' end as role, min(depth)::int as depth from m join c using (node) where c.k = m.k group by node, m.k
"""


@_add("context_order", _ROLES)
def _(spark, d):
    return context.priority(_edges(spark, d), _changed(spark))


@_add("token_estimate", "select doc_id, greatest(1, length(text) // 4)::int as tokens from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", context.tokens("text").alias("tokens"))


_PACK = f"""with recursive it as (select doc_id::varchar as node, greatest(1, n_chars // 4)::bigint as f, (20 + length(lang || source))::bigint as st, row_number() over (order by n_chars, doc_id::varchar) as k from documents),
z as (select 0::bigint as k, {context.BUDGET}::bigint as budget, ''::varchar as node, ''::varchar as mode, 0::bigint as cost
 union all select it.k, budget - case when f <= budget then f when st <= budget then st else 0 end, it.node, case when f <= budget then 'full' when st <= budget then 'stub' else 'omitted' end, case when f <= budget then f when st <= budget then st else 0 end from z join it on it.k = z.k + 1)
select node, (k - 1)::int as place, mode, cost from z where k > 0
"""


@_add("context_pack", _PACK)
def _(spark, d):
    docs = table(spark, d, "documents")
    items = docs.select(F.col("doc_id").cast("string").alias("node"), F.lit(0).alias("role_rank"), F.col("n_chars").alias("depth"), F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).alias("full_cost"), (20 + F.length(F.concat("lang", "source"))).alias("stub_cost"))
    return context.packed(items, context.BUDGET)


# Parsed sources

@_add("corpus_imports", corpus.IMPORTS_SQL)
def _(spark, d):
    return corpus.graphs(spark, d)["imports"].select("file", "kind", "raw", "imported_name", "resolved_file", "resolution")


@_add("corpus_unresolved", corpus.UNRESOLVED_SQL)
def _(spark, d):
    return corpus.graphs(spark, d)["unresolved"].select("file", "kind", "raw", "reason")


@_add("corpus_calls", corpus.CALLS_SQL)
def _(spark, d):
    return corpus.graphs(spark, d)["calls"].select("caller", "callee")


@_add("corpus_functions", corpus._BOUGHT + "select c_file || '::buy' as fid, c_file as file, 'buy' as name from c union all select s_file || '::ship', s_file, 'ship' from s")
def _(spark, d):
    return corpus.graphs(spark, d)["nodes"]


@_add("ref_asof", "select r.event_id, r.user_id, b.value as target from events r asof left join (select * from events where event_type = 'purchase') b on r.user_id = b.user_id and r.event_id > b.event_id")
def _(spark, d):
    events = table(spark, d, "events")
    refs = events.select(F.col("user_id").alias("file"), F.col("event_id").alias("ord"), F.lit("purchase").alias("ref_name"))
    bound = events.select(F.col("user_id").alias("file"), F.col("event_id").alias("ord"), F.col("event_type").alias("bound"), F.col("value").alias("target"))
    return resolve.as_of(refs, bound).select(F.col("ord").alias("event_id"), F.col("file").alias("user_id"), "target")


# Text and jobs

@_add("dot_lines", """select 0 as section, '0' as place, 'digraph module_graph {' as line union all select 0, '1', '  rankdir="LR";' union all select 0, '2', '  node [shape=box];' union all select 9, '', '}'
 union all select 1, n, '  "' || n || '" [label="' || case when starts_with(n, 'world/') then substr(n, 7) else n end || '"];' from (select 'world/' || n_name as n from nation union select 'world/' || r_name from region)
 union all select 2, 'world/' || n_name || chr(1) || lpad(n_nationkey::varchar, 10, '0'), '  "world/' || n_name || '" -> "world/' || r_name || '";' from nation join region on n_regionkey = r_regionkey""")
def _(spark, d):
    links = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    imports = links.select(F.concat(F.lit("world/"), "n_name").alias("file"), F.col("n_nationkey").alias("ord"), F.concat(F.lit("world/"), "r_name").alias("resolved_file"))
    return export.dot_lines(imports.select("file"), imports, "world")


@_add("job_list", f"select event_id::varchar as job_id, epoch_us(ts) / 1e6 as created_at from events order by created_at desc, job_id limit {job_table.LISTED}")
def _(spark, d):
    jobs = table(spark, d, "events").select(F.col("event_id").cast("string").alias("job_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created_at"))
    return job_table.listing(jobs)
