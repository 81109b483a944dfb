"""A log of jobs that they keep themselves: a row for each change of state, appended as the job goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import reports
from quarry.sources.scratch import stored

SCHEMA = (
    "job_id string, status string, step int, message string, files_processed long, files_successful long, files_failed long, total_chunks long, "
    "failed_files array<string>, error_message string, started_at timestamp, completed_at timestamp, updated_at timestamp"
)
#: Steps of a job; a later one counts, also where two have the same time.
QUEUED, RUNNING, ENDED = 0, 1, 2


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log at ``path``; none where it has not begun."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def job_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every job of the log."""
    return reports.job_status(read_log(spark, path), ("step", "updated_at"))


def _append(rows: DataFrame, path: str) -> None:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kinds = dict(part.split() for part in SCHEMA.split(", "))
    rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names]).coalesce(1).write.mode("append").parquet(path)


def _state(spark: SparkSession, job_id: str, status: str, step: int, **more: object) -> DataFrame:
    row = spark.range(1).select(F.lit(job_id).alias("job_id"), F.lit(status).alias("status"), F.lit(step).alias("step"), F.current_timestamp().alias("updated_at"))
    return row.withColumns({c: v if not isinstance(v, str) else F.lit(v) for c, v in more.items()})


def queue_job(spark: SparkSession, path: str, job_id: str) -> None:
    """Log a job that is to be run. An id is one run's; the state of an id that is used again is that of its latest step."""
    _append(_state(spark, job_id, "queued", QUEUED, message="Job queued", started_at=F.current_timestamp()), path)


def run_job(spark: SparkSession, path: str, job_id: str, job: Callable[[], DataFrame]) -> DataFrame:
    """Run ``job``, which returns results per file, and log that it runs and how it ended; its results.

    A job that raises is logged as failed with its message, and raises. One that ends has completed, with its counts and up to ten
    failed files; files that fail don't make it fail.
    """
    started = spark.range(1).select(F.current_timestamp().alias("t")).first()[0]
    _append(_state(spark, job_id, "running", RUNNING, message="Processing files...", started_at=F.lit(started)), path)
    try:
        results = stored(job(), "results")
        totals = reports.job_update(results, job_id)
        ended = totals.withColumns({"status": F.lit("completed"), "step": F.lit(ENDED), "message": F.lit("Indexing completed successfully"), "started_at": F.lit(started)})
        _append(ended, path)
    except Exception as error:
        said = (str(error).strip().splitlines() or [type(error).__name__])[0]
        _append(_state(spark, job_id, "failed", ENDED, message=f"Indexing failed: {said}", error_message=said, started_at=F.lit(started), completed_at=F.current_timestamp()), path)
        raise
    return results
