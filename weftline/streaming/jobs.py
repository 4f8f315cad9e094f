"""Scan jobs as a stream of requests.

Requests arrive as JSON files in a folder; a stream takes them in order of arrival and writes
a job row per state, when the job gets there, to a Parquet table partitioned by job and state.
A job's row of the last state is the job. A batch that is taken again, as after a crash,
rewrites the states it has and leaves finished jobs alone.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JOB = "job_id string, status string, path string, error string, created_at double, seq int"
LISTED = 50
#: States in order; a job ends as done or error.
QUEUED, RUNNING, ENDED = ("queued", 0), ("running", 1), 2


class NotFound(LookupError):
    """No such job."""


class NotDone(RuntimeError):
    """The job has no result yet, or never will."""


def submit(folder: str, path: str) -> str:
    """A request to scan a directory; returns the job's identifier."""
    if not Path(path).is_dir():
        raise NotADirectoryError(path)
    job = uuid.uuid4().hex
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    (part := at / f".{job}").write_text(json.dumps({"job_id": job, "path": path, "created_at": time.time()}))
    part.rename(at / f"{job}.json")
    return job


def _write(states: DataFrame, jobs: str) -> None:
    states.write.partitionBy("job_id", "seq").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(jobs)


def work(spark: SparkSession, folder: str, jobs: str, results: str, checkpoint: str, scan: Callable[[SparkSession, str], dict[str, DataFrame]]) -> None:
    """Runs all requests that have arrived, each to done or error, and returns; progress is in the checkpoint."""

    def run(batch: DataFrame, _: int) -> None:
        _write(batch.select("job_id", F.lit(QUEUED[0]).alias("status"), "path", F.lit(None).cast("string").alias("error"), "created_at", F.lit(QUEUED[1]).alias("seq")), jobs)
        ended = batch.sparkSession.read.schema(JOB).parquet(jobs).filter(F.col("seq") == ENDED).select("job_id")
        for r in batch.join(ended, "job_id", "left_anti").orderBy("created_at", "job_id").toLocalIterator():
            state = lambda status, seq, error=None: _write(spark.createDataFrame([(r["job_id"], status, r["path"], error, r["created_at"], seq)], JOB).coalesce(1), jobs)  # noqa: B023, E731
            state(*RUNNING)
            try:
                for name, df in scan(spark, r["path"]).items():
                    df.write.mode("overwrite").parquet(f"{results}/{r['job_id']}/{name}")
            except Exception as e:  # any failure is the job's outcome, not the stream's
                state("error", ENDED, str(e))
            else:
                state("done", ENDED)

    requests = spark.readStream.schema("job_id string, path string, created_at double").json(folder)
    requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(jobs: DataFrame) -> DataFrame:
    """Each job in its last state."""
    last = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    return jobs.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth", "seq")


def listing(jobs: DataFrame, limit: int = LISTED) -> DataFrame:
    """Newest first."""
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)


def get(jobs: DataFrame, job_id: str) -> dict:
    row = current(jobs).filter(F.col("job_id") == job_id).first()
    if row is None:
        raise NotFound(job_id)
    return row.asDict()


def completed(jobs: DataFrame, job_id: str) -> dict:
    job = get(jobs, job_id)
    if job["status"] != "done":
        raise NotDone(f"{job_id} is {job['status']}")
    return job


def result(spark: SparkSession, jobs: DataFrame, results: str, job_id: str, part: str) -> DataFrame:
    """imports, unresolved or function_edges of a finished job."""
    completed(jobs, job_id)
    return spark.read.parquet(f"{results}/{job_id}/{part}")
