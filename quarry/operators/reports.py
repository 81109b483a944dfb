"""Reports on runs: results per file, totals, failures, retries, jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The share of chunks to files in the estimate of files.
CHUNKS_PER_FILE = 4
FAILED_SHOWN = 10


def file_results(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file_path, success, chunks_created, chunks_stored, error_message`` for every file.

    ``files`` has ``filepath, parser, route_error, content`` and may have ``failure`` (an exception's text) and
    ``processing_time``; ``chunks`` has ``filepath`` and ``embedding``. The first of these that holds is the error:
    an exception, an unsupported type, no content, no chunks, fewer vectors than chunks.
    """
    return results_of(files, chunks.groupBy("filepath").agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("m")))


def results_of(files: DataFrame, counts: DataFrame) -> DataFrame:
    """The same of counted chunks and vectors: ``filepath, n, m``."""
    failure = F.col("failure") if "failure" in files.columns else F.lit(None).cast("string")
    spent = F.col("processing_time") if "processing_time" in files.columns else F.lit(0.0)
    # Contents are measured before the join, or it would move them.
    empty = F.coalesce(F.length("content"), F.lit(0)) == 0
    df = files.select("filepath", "parser", "route_error", failure.alias("failure"), empty.alias("empty"), spent.alias("processing_time"))
    df = df.join(counts, "filepath", "left").na.fill(0, ["n", "m"])
    early = (
        F.when(F.col("failure").isNotNull(), F.concat(F.lit("Processing error: "), "failure"))
        .when(F.col("parser").isNull(), F.col("route_error"))
        .when(F.col("empty"), F.lit("No content extracted from file"))
        .when(F.col("n") == 0, F.lit("No chunks created from text"))
    )
    late = F.when(F.col("n") != F.col("m"), F.format_string("Embedding count mismatch: %d chunks, %d embeddings", "n", "m"))
    made = F.when(early.isNotNull(), F.lit(0)).otherwise(F.col("n"))
    error = F.coalesce(early, late)
    return df.select(
        F.col("filepath").alias("file_path"), error.isNull().alias("success"), made.alias("chunks_created"), F.when(error.isNull(), made).otherwise(F.lit(0)).alias("chunks_stored"),
        error.alias("error_message"), "processing_time",
    )


def pipeline_stats(results: DataFrame) -> DataFrame:
    """One row of totals; chunks are those of successful files."""
    n = F.count(F.lit(1))
    total = F.coalesce(F.sum("processing_time"), F.lit(0.0))
    return results.agg(
        n.alias("files_processed"),
        F.count_if("success").alias("files_successful"),
        F.count_if(~F.col("success")).alias("files_failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("chunks_created"))), F.lit(0)).alias("total_chunks"),
        total.alias("total_time"),
        F.when(n > 0, total / n).otherwise(0.0).alias("average_time"),
    )


def failed_files(results: DataFrame, limit: int | None = FAILED_SHOWN) -> DataFrame:
    """Paths that failed, in order; the report of a job shows the first ten."""
    rows = results.filter(~F.col("success")).select("file_path", "error_message").orderBy("file_path")
    return rows.limit(limit) if limit is not None else rows


def retry_failed(results: DataFrame, files: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results after processing the failed files again; the others are as they were."""
    failed = results.filter(~F.col("success")).select(F.col("file_path").alias("filepath"))
    again = process(files.join(failed, "filepath", "left_semi"))
    kept = results.join(again.select("file_path"), "file_path", "left_anti")
    return kept.unionByName(again)


def human_size(n: Column) -> Column:
    """A size in words; a half at the second digit goes to the even one, as in C and Python. Null for null."""
    mib, kib = 1024 * 1024, 1024
    tenths = lambda x, unit: F.format_string(f"%.1f {unit}", F.bround(x, 1))
    return F.when(n > mib, tenths(n / mib, "MB")).when(n > kib, tenths(n / kib, "KB")).when(n.isNotNull(), F.format_string("%d B", n))


def system_stats(collection: DataFrame, jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: chunks, files (estimated from chunks, and counted), when indexing last ended, size on disk."""
    chunks = collection.agg(F.count(F.lit(1)).alias("total_chunks"), F.count_distinct("filepath").alias("distinct_files"))
    last = jobs.filter(F.col("status") == "completed").agg(F.coalesce(F.max("completed_at").cast("string"), F.lit("Never")).alias("last_indexed"))
    size = listing.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    out = chunks.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(size))
    estimate = F.greatest(F.lit(1), F.floor(F.col("total_chunks") / CHUNKS_PER_FILE))
    return out.select("total_chunks", estimate.alias("file_count"), "distinct_files", "last_indexed", human_size(F.col("bytes")).alias("size"))


def job_status(updates: DataFrame, order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The latest update of every job, as a row with the updates' own columns."""
    rest = [c for c in updates.columns if c != "job_id"]
    latest = updates.groupBy("job_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("u"))
    return latest.select("job_id", "u.*")


def job_list(jobs: DataFrame) -> DataFrame:
    """All jobs, newest first."""
    return jobs.orderBy(F.desc("started_at"), "job_id")


def job_update(results: DataFrame, job_id: str) -> DataFrame:
    """The job log's row for a run that has ended: its counts and up to ten failed paths, as :func:`job_status` reads them.

    A run in which every file failed has ``failed``; one without files has completed.
    """
    totals = pipeline_stats(results)
    failed = failed_files(results).agg(F.array_sort(F.collect_list("file_path")).alias("failed_files"))
    lost = (F.col("files_processed") > 0) & (F.col("files_successful") == 0)
    now = F.current_timestamp()
    return totals.crossJoin(F.broadcast(failed)).select(
        F.lit(job_id).alias("job_id"), F.when(lost, "failed").otherwise("completed").alias("status"), F.lit(1.0).alias("progress"), "files_processed", "files_successful",
        "files_failed", "total_chunks", "failed_files", now.alias("completed_at"), now.alias("updated_at"),
    )
