"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. A line's frequency is the share of the host's pages that
contain it; lines above a ratio, and on LEAST_HELD pages at least, are boilerplate and are
dropped from all of that host's pages. Hosts of any size are judged alike. Lines compare
without leading and trailing blanks; blank lines are never dropped.

A page counts a line once, and counts are summed before the shuffle, so neither a host
with a third of all pages nor a line on all of them gathers rows. A host can have no more
than (lines per page / ratio) boilerplate lines, which is what a page is held against: by
broadcast while they are few in all, else by a join in which the pages of a large host are dealt
into shares of some DEALT pages.

A null text stays null and has no lines; an empty one has one blank line. Null and empty
hosts are one host. Rows repeated are pages of their own. An empty table gives an
empty result. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, free_name, small_enough

RATIO = 0.05
LEAST_HELD = 2
#: Boilerplate lines that may go by broadcast: at some 40 bytes each, 4 MB.
BROADCAST_LINES = 100_000
#: Pages of a host in one share, where the lines are too many for that; hosts of more that may go by broadcast.
DEALT, BROADCAST_HOSTS = 100_000, 200_000

BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _hash(line: Column) -> Column:
    """128 bits of a line, so that chance meetings are out of the question at any size."""
    return F.struct(F.xxhash64(_trimmed(line)).alias("a"), F.xxhash64(F.lit(1), _trimmed(line)).alias("b"))


def boilerplate(docs: DataFrame, host: Column, text_col: str, ratio: float = RATIO, least_held: int = LEAST_HELD) -> DataFrame:
    """host, total (its pages), lines: the hashes of each host's boilerplate lines, which lie on least_held pages at least."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    pages = docs.select(host.alias("host"), F.filter(_lines(text), lambda x: _trimmed(x) != "").alias("lines"))
    held = pages.select("host", F.explode(F.array_distinct(F.transform("lines", _hash))).alias("line"))
    counts = held.groupBy("host", "line.a", "line.b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_held)
    totals = docs.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("total"))
    above = counts.join(totals, "host").filter(F.col("n") > F.lit(float(ratio)) * F.col("total"))
    return above.groupBy("host").agg(F.first("total").alias("total"), F.collect_list(F.struct("a", "b")).alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str | Column = "source", text_col: str = "text", ratio: float = RATIO, least_held: int = LEAST_HELD, length_col: str | None = None, counts: bool = False) -> DataFrame:
    """docs with boilerplate lines gone from text_col.

    length_col, if given, gets the new number of characters. counts adds n_lines and n_dropped.
    """
    key = F.coalesce((F.col(host) if isinstance(host, str) else host).cast("string"), F.lit(""))
    h, s, m, lines, kept = free_name(docs, "host", "salt", "shares", "lines", "kept")
    found = cut(boilerplate(docs, key, text_col, ratio, least_held).withColumnsRenamed({"host": h, "lines": lines}))
    own = found.select(h, lines)
    if small_enough(found.select(F.explode(lines)), BROADCAST_LINES):
        held = docs.withColumn(h, key).join(F.broadcast(own), h, "left")
    else:
        shares = found.select(h, F.ceil(F.col("total") / DEALT).cast("int").alias(m))
        large = cut(shares.filter(F.col(m) > 1))
        dealt = docs.withColumn(h, key).join(F.broadcast(large) if small_enough(large, BROADCAST_HOSTS) else large, h, "left")
        dealt = dealt.withColumn(s, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(F.col(m), F.lit(1))).cast("int")).drop(m)
        salted = own.join(shares, h).withColumn(s, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop(m)
        held = dealt.join(salted, [h, s], "left")
    every = _lines(F.col(text_col).cast("string"))
    stays = F.filter(every, lambda x: (_trimmed(x) == "") | ~F.array_contains(F.col(lines), _hash(x)))
    out = held.withColumn(kept, F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(stays, "\n")))
    values = {text_col: F.col(kept)} | ({length_col: F.length(kept).cast(docs.schema[length_col].dataType)} if length_col else {})
    columns = [values.get(c, F.col(c)).alias(c) for c in docs.columns]
    if counts:
        n = F.coalesce(F.size(every), F.lit(0)).cast("long")
        columns += [n.alias("n_lines"), F.when(F.col(lines).isNull() | F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(n - F.size(stays)).alias("n_dropped")]
    return out.select(*columns)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_chars, kept_sha256."""
    out = drop_boilerplate(docs, counts=True)
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
with d as (select doc_id, coalesce(source, '') as host, text, string_split(text, chr(10)) as ls, row_number() over () as rid from documents),
l as (select distinct rid, host, trim(x, ' ' || chr(9) || chr(13)) as line from (select rid, host, unnest(ls) as x from d)),
c as (select host, line, count(*) as n from l where line <> '' group by host, line),
t as (select host, count(*) as total from d group by host),
b as (select host, list(line) as lines from c join t using (host) where n >= {LEAST_HELD} and n > {RATIO}::double * total group by host),
k as (select d.doc_id, d.ls, list_filter(d.ls, lambda x: trim(x, ' ' || chr(9) || chr(13)) = '' or b.lines is null or not list_contains(b.lines, trim(x, ' ' || chr(9) || chr(13)))) as kept from d left join b using (host))
select doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(len(ls) - len(kept), 0)::bigint as n_dropped,
 coalesce(length(array_to_string(kept, chr(10))), 0)::bigint as kept_chars, sha256(coalesce(array_to_string(kept, chr(10)), '')) as kept_sha256 from k
"""
