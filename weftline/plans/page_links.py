"""Links of web pages as import entries: something to review, override, diff and classify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.key_graph import table

FAR, ABSENT = "third-party address", "no such page"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per link, those of even length resolved; aliases are null for some."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("file"), "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ord", "raw"))
    n = F.length("raw")
    even = n % 2 == 0
    return links.select(
        "file", F.col("ord").cast("int").alias("ord"), F.when(n % 3 == 0, "import").otherwise("from_import").alias("kind"), "raw",
        F.when(n % 5 != 0, F.regexp_extract("raw", "([^/]*)$", 1)).alias("imported_name"), F.when(n % 7 > 2, F.lit("a")).alias("alias"), (F.col("ord") + 1).cast("int").alias("line"),
        F.when(even, F.concat(F.lit("site"), "raw")).alias("resolved_file"), F.when(even, F.when(n % 3 == 0, "submodule").otherwise("name_inside_module")).alias("resolution"),
        F.when(~even, F.when(n % 3 == 1, FAR).otherwise(ABSENT)).alias("reason"), "url",
    )


ENTRIES_SQL = f"""
l as (select 'page/' || page_id || '.html' as file, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as raw, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1)::int - 1 as ord from pages),
ent as (select file, url, raw, ord, case when length(raw) % 3 = 0 then 'import' else 'from_import' end as kind,
 case when length(raw) % 5 <> 0 then regexp_extract(raw, '([^/]*)$', 1) end as imported_name, case when length(raw) % 7 > 2 then 'a' end as alias, ord + 1 as line,
 case when length(raw) % 2 = 0 then 'site' || raw end as resolved_file, case when length(raw) % 2 = 0 then case when length(raw) % 3 = 0 then 'submodule' else 'name_inside_module' end end as resolution,
 case when length(raw) % 2 = 1 then case when length(raw) % 3 = 1 then '{FAR}' else '{ABSENT}' end end as reason from l),
keyed as (select *, file || ':' || line || ':' || raw || case when coalesce(imported_name, '') = '' then '' else ':' || imported_name end as key from ent)
"""


def store(entries_: DataFrame) -> DataFrame:
    """A decision on most entries, and one on an entry that is gone from each page."""
    from weftline.operators.overrides import decisions, upsert

    n = F.length("raw")
    confirmed = decisions(entries_.filter(n % 4 == 1), "confirm", F.concat(F.lit("seen"), "raw"))
    manual = decisions(entries_.filter(n % 4 == 3), "manual", F.when(n % 3 != 0, F.concat(F.lit("given"), "raw")).otherwise(""))
    rejected = decisions(entries_.filter(n % 8 == 2), "reject")
    gone = decisions(entries_.filter("ord = 0").withColumn("line", F.lit(-5)), "reject")
    out = confirmed
    for part in (manual, rejected, gone):
        out = upsert(out, part)
    return out


STORE_SQL = f"""
{ENTRIES_SQL.strip()},
store as (select key, 'confirm' as decision, 'seen' || raw as target from keyed where length(raw) % 4 = 1
 union all select key, 'manual', case when length(raw) % 3 <> 0 then 'given' || raw else '' end from keyed where length(raw) % 4 = 3
 union all select key, 'reject', null from keyed where length(raw) % 8 = 2
 union all select distinct file || ':-5:' || raw || case when coalesce(imported_name, '') = '' then '' else ':' || imported_name end, 'reject', null from keyed where ord = 0)
"""
