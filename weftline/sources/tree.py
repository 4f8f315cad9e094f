"""Source trees as DataFrames, by a Python data source.

Spark's own file sources hide names that begin with an underscore or a dot, package
initialisers among them, so the tree is listed here: directories and all. Listing and
reading are separate; what needs names only never touches bytes. Paths must be on a file
system that the driver and all executors mount alike.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.sources.config import EXCLUDED
from weftline.sources.gitignore import Ignore

#: Files read by one task.
SLICE = 500


def is_exist(path: str) -> str:
    return "exists" if os.path.isdir(path) else "incorrect-path"


def listed(root: str) -> Iterator[tuple[str, bool]]:
    """(path, is directory) of everything below root, hidden names included, sorted within directories."""
    for at, dirs, names in os.walk(root):
        dirs.sort()
        for d in dirs:
            yield os.path.join(at, d), True
        for n in sorted(names):
            yield os.path.join(at, n), False


class _Slice(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_Slice(self.paths[k : k + SLICE]) for k in range(0, len(self.paths), SLICE)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                data = f.read()
            yield path, data, len(data)


class SourceTree(DataSource):
    """spark.read.format("srctree").load(root): file, content, size of every .py file below root."""

    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return "file string, content binary, size long"

    def reader(self, schema) -> DataSourceReader:
        ending = self.options.get("ending", ".py")
        return _Reader([p for p, d in listed(self.options["path"]) if not d and p.endswith(ending)])


def resolved_root(root: str) -> str:
    return str(Path(root).resolve())


def paths(spark: SparkSession, root: str) -> DataFrame:
    """(path, is_dir) of the whole tree: the universe that imports resolve in."""
    rows = list(listed(resolved_root(root)))
    return spark.createDataFrame(rows, "path string, is_dir boolean")


def scanned(tree: DataFrame, root: str, exclude: str = EXCLUDED, ignore_text: str | None = None) -> DataFrame:
    """(file, rel, name, ext) of files that survive the name pattern and the root's ignore file; any ending."""
    root = resolved_root(root)
    if ignore_text is None:
        at = Path(root, ".gitignore")
        ignore_text = at.read_text() if at.exists() else ""
    rules, pattern = Ignore(ignore_text), re.compile(exclude)
    keep = F.udf(lambda rel: not pattern.match(rel.rpartition("/")[2]) and not rules(rel), "boolean")
    rel = F.col("path").substr(F.lit(len(root) + 2), F.length("path"))
    name = F.element_at(F.split("rel", "/"), -1)
    files = tree.filter("not is_dir").select(F.col("path").alias("file"), rel.alias("rel")).filter(keep("rel"))
    return files.select("file", "rel", name.alias("name"), F.regexp_extract(name, r".(\.[^.]*)$", 1).alias("ext"))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(file, content, size) of the tree's Python files, scanned or not."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("srctree").load(resolved_root(root))
