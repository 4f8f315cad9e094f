"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.lineage import cut, shared_dir, small_enough

__all__ = ["cut", "file_system", "free_name", "join_groups", "partitions", "raw", "scratch", "settings", "shared_dir", "small_enough", "table", "valid_text", "without"]


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as __) for the jobs run inside the block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df doesn't have yet, one for each wanted name."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def raw(text: str) -> F.Column:
    """The text's UTF-8 bytes, null as none."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def valid_text(text: str) -> F.Column:
    """The text, with U+FFFD for bytes that aren't UTF-8, which Python can't read; null stays null."""
    return F.make_valid_utf8(F.col(text).cast("string"))


def file_system(spark: SparkSession, path: str) -> tuple:
    """The path's file system and the path, as the cluster knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed with the session's end where that can still be done."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        with suppress(Exception):
            fs, at = file_system(spark, path)
            fs.delete(at, True)

    atexit.register(remove)
    return path


#: Groups that join_groups() joins by broadcast, the largest ones; a fixed number, whatever the input.
LARGEST_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with groups, which has one row per key; size names its count of rows.

    The largest groups go by broadcast, so that no shuffled key holds more than one row
    in LARGEST_GROUPS; all others by a shuffle join. Keys hold no nulls.
    """
    values = [c for c in groups.columns if c not in keys]
    largest = groups.orderBy(F.desc(size), *keys).limit(LARGEST_GROUPS).filter(F.col(size) > 1)
    mark, *named = free_name(rows, "large", *(f"large_{c}" for c in values))
    largest = largest.select(*keys, F.lit(True).alias(mark), *(F.col(c).alias(n) for c, n in zip(values, named)))
    tagged = rows.join(F.broadcast(largest), keys, "left")
    own = [c for c in rows.columns if c not in keys]
    large = tagged.filter(F.col(mark)).select(*keys, *own, *(F.col(n).alias(c) for c, n in zip(values, named)))
    rest = tagged.filter(F.col(mark).isNull()).select(*keys, *own).join(groups, keys, how).select(*keys, *own, *values)
    return large.union(rest)


def without(docs: DataFrame, drop: DataFrame, key: str, broadcast_rows: int = 500_000) -> DataFrame:
    """docs less those whose key is in drop (distinct); by broadcast only where drop is counted and small."""
    drop = cut(drop)
    return docs.join(F.broadcast(drop) if small_enough(drop, broadcast_rows) else drop, key, "left_anti")
