"""Session defaults. Library code never builds a session itself; entry points do."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "weftline", cores: str = "8", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per context, unless their path already leads to it."""
    home = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(home) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_weftline_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(home.glob("weftline/**/*.py")):
            out.write(source, source.relative_to(home))
    context.addPyFile(str(path))
    context._weftline_shipped = True
