"""Reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, reports, text
from quarry.queries import frames as fr
from quarry.queries.chunks import token_sql


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of all types; behind them some without content and some blank ones; some with an exception."""
    docs = fr.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    empty = docs.filter("doc_id % 10 = 5").withColumns({"doc_id": F.col("doc_id") + 1000000000, "text": F.lit("")})
    blank = docs.filter("doc_id % 10 = 6").withColumns({"doc_id": F.col("doc_id") + 1000000000, "text": F.lit(" \n\t")})
    n = F.col("doc_id")
    suffix = F.when(n % 10 == 3, ".xyz").when(n % 10 == 4, ".md").otherwise(".txt")
    rows = docs.unionByName(empty).unionByName(blank).select(
        F.concat(F.lit("/"), "source", F.lit("/"), n.cast("string"), suffix).alias("filepath"),
        F.col("text").alias("content"),
        F.when(n % 10 == 7, F.lit("broken")).alias("failure"),
        (n % 100 / 64.0).alias("processing_time"),
    )
    return text.route_parser(rows, "filepath").withColumnRenamed("error", "route_error")


def _process(files: DataFrame) -> DataFrame:
    """Results of files; every third chunk number from two on of one path in eight has no vector."""
    chunks = chunking.chunk_token(files.select("filepath", F.col("content").alias("text")))
    lost = (F.col("chunk_index") % 3 == 2) & F.substring(F.md5("filepath"), 1, 1).isin("0", "1")
    chunks = chunks.select("filepath", F.when(~lost, F.array(F.lit(1.0))).alias("embedding"))
    return reports.file_results(files, chunks)


_FILES = """(SELECT '/' || source || '/' || doc_id || CASE doc_id % 10 WHEN 3 THEN '.xyz' WHEN 4 THEN '.md' ELSE '.txt' END AS filepath,
  text, CASE WHEN doc_id % 10 = 7 THEN 'broken' END AS failure, doc_id % 100 / 64.0::DOUBLE AS t FROM (SELECT doc_id, source, text FROM documents
    UNION ALL SELECT doc_id + 1000000000, source, CASE doc_id % 10 WHEN 5 THEN '' ELSE ' ' || chr(10) || chr(9) END FROM documents WHERE doc_id % 10 IN (5, 6)))"""


def results_sql(source: str) -> str:
    return f"""(SELECT filepath AS file_path, coalesce(early, late) IS NULL AS success, CASE WHEN early IS NULL THEN n ELSE 0 END AS chunks_created,
  CASE WHEN early IS NULL AND late IS NULL THEN n ELSE 0 END AS chunks_stored, coalesce(early, late) AS error_message, t AS processing_time FROM (
  SELECT *, CASE WHEN failure IS NOT NULL THEN 'Processing error: ' || failure WHEN ends_with(filepath, '.xyz') THEN 'Unsupported file type: .xyz'
    WHEN text = '' THEN 'No content extracted from file' WHEN n = 0 THEN 'No chunks created from text' END AS early,
    CASE WHEN n <> m THEN 'Embedding count mismatch: ' || n || ' chunks, ' || m || ' embeddings' END AS late FROM (
    SELECT f.*, coalesce(c.n, 0) AS n, coalesce(c.m, 0) AS m FROM {source} f LEFT JOIN
      (SELECT filepath, count(*) AS n, count(*) FILTER (NOT (chunk_index % 3 = 2 AND md5(filepath)[1] IN ('0', '1'))) AS m FROM {token_sql(source, 'filepath')} GROUP BY filepath) c USING (filepath))))"""


RESULTS = results_sql(_FILES)


def file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _process(_files(spark, sf_dir))


def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pipeline_stats(file_results(spark, sf_dir)).withColumn("average_time", F.round("average_time", 6))


STATS = f"""SELECT count(*) AS files_processed, count(*) FILTER (success) AS files_successful, count(*) FILTER (NOT success) AS files_failed,
  coalesce(sum(chunks_created) FILTER (success), 0)::BIGINT AS total_chunks, sum(processing_time) AS total_time, round(sum(processing_time) / count(*), 6) AS average_time FROM {RESULTS}"""


def failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failed_files(file_results(spark, sf_dir))


def retry_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with an exception are sound when they are tried again."""
    files = _files(spark, sf_dir)
    return reports.retry_failed(_process(files), files, lambda again: _process(again.withColumn("failure", F.lit(None).cast("string"))))


RETRIED = f"""WITH a AS (SELECT * FROM {RESULTS}), b AS (SELECT * FROM {results_sql(f"(SELECT filepath, text, NULL::VARCHAR AS failure, t FROM {_FILES})")})
SELECT * FROM a WHERE success UNION ALL SELECT b.* FROM b JOIN a USING (file_path) WHERE NOT a.success"""


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job log: an event is an update of its user's job."""
    states = F.create_map(*[F.lit(x) for pair in (("signup", "queued"), ("view", "running"), ("click", "running"), ("purchase", "completed"), ("error", "failed")) for x in pair])
    status = F.element_at(states, F.col("event_type"))
    return fr.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), status.alias("status"), F.col("value").alias("progress"), F.col("ts").alias("updated_at"), "event_id",
        F.when(status == "completed", F.col("ts")).alias("completed_at"),
    )


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.job_status(_updates(spark, sf_dir), ("updated_at", "event_id"))
    return out.select("job_id", "status", "progress", "updated_at")


_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END"
JOB = f"""SELECT user_id AS job_id, {_STATUS} AS status, value AS progress, ts AS updated_at FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = _updates(spark, sf_dir)
    started = updates.groupBy("job_id").agg(F.min("updated_at").alias("started_at"))
    return reports.job_status(updates, ("updated_at", "event_id")).join(started, "job_id")


def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.job_list(_jobs(spark, sf_dir).select("job_id", "status", "started_at"))


JOBS = f"""SELECT job_id, status, started_at FROM (SELECT user_id AS job_id, {_STATUS} AS status, min(ts) OVER (PARTITION BY user_id) AS started_at,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""


def system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_token(fr.documents(spark, sf_dir))
    return reports.system_stats(chunks, _updates(spark, sf_dir), fr.files(spark, sf_dir))


_SIZE = "CASE WHEN n > 1048576 THEN printf('%.1f MB', n / 1048576) WHEN n > 1024 THEN printf('%.1f KB', n / 1024) ELSE n || ' B' END"
SYSTEM = f"""WITH c AS (SELECT count(*) AS n, count(DISTINCT filepath) AS f FROM {token_sql(fr.DOCUMENTS, 'filepath')}),
j AS (SELECT coalesce(rtrim(rtrim(strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.'), 'Never') AS last FROM events WHERE event_type = 'purchase'), s AS (SELECT sum(length)::BIGINT AS n FROM {fr.FILES})
SELECT c.n AS total_chunks, greatest(1, c.n // 4) AS file_count, f AS distinct_files, last AS last_indexed, (SELECT {_SIZE} FROM s) AS size FROM c, j"""


def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("length") * (F.col("length") % 3)
    return fr.files(spark, sf_dir).select("path", reports.human_size(n).alias("size"))


HUMAN = f"SELECT path, {_SIZE} AS size FROM (SELECT path, length * (length % 3) AS n FROM {fr.FILES})"


QUERIES = {
    "file_results": (file_results, f"SELECT * FROM {RESULTS}"),
    "pipeline_stats": (pipeline_stats, STATS),
    "failed_files": (failed_files, f"SELECT file_path, error_message FROM {RESULTS} WHERE NOT success ORDER BY file_path LIMIT 10"),
    "retry_failed": (retry_failed, RETRIED),
    "system_stats": (system_stats, SYSTEM),
    "human_size": (human_size, HUMAN),
    "job_status": (job_status, JOB),
    "job_list": (job_list, JOBS),
}
