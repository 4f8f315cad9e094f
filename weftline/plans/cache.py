"""The fact cache: two Parquet tables a version, and a pointer to the current version.

A version is written whole before the pointer moves, so a run may read the cache that it
replaces, and a broken or missing cache is an empty one.
"""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline.functions.facts import FACT

POINTER = "CURRENT"


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, facts) of the last run; both empty if there was none."""
    at = Path(path).absolute()
    try:
        version = at / (at / POINTER).read_text().strip()
        return spark.read.schema("file string, hash string").parquet(f"file://{version}/files"), spark.read.schema(FACT).parquet(f"file://{version}/facts")
    except Exception:  # whatever is wrong with a cache, the answer is to do without
        return spark.createDataFrame([], "file string, hash string"), spark.createDataFrame([], FACT)


def save(files: DataFrame, facts: DataFrame, path: str) -> None:
    """Replaces the cache by what this run saw; what is gone from the tree goes from the cache."""
    at = Path(path).absolute()
    at.mkdir(parents=True, exist_ok=True)
    version = at / uuid.uuid4().hex
    files.write.parquet(f"file://{version}/files")
    facts.write.parquet(f"file://{version}/facts")
    old = [p for p in at.iterdir() if p.is_dir() and p != version]
    (fresh := at / f".{version.name}").write_text(version.name)
    fresh.replace(at / POINTER)
    for p in old:
        shutil.rmtree(p, ignore_errors=True)
