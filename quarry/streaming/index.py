"""Incremental indexing: files that appear or change in a directory are indexed, and what is gone leaves the collection."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.jobs import index
from quarry.sources import collection, files, watch
from quarry.sources.scratch import drop_stored, stored


def stream_index(
    spark: SparkSession, directory: str, target: str, checkpoint: str, max_file_mb: float = files.MAX_FILE_MB, report: str | None = None, **settings
) -> StreamingQuery:
    """Bring the collection up to date with ``directory`` and stop; started again with the same checkpoint, it takes what changed since.

    The stream has the files that are newer than the last one seen; a file that is older than that and not yet in the
    collection, such as one moved in, is found by the batch's own listing. An edited file's chunks replace its old ones,
    and a deleted file's go. A batch is a part of the collection that is named by the checkpoint and the batch, so one that
    is run again after a failure replaces what it had stored. Files that fail are left out of the collection and don't stop
    the others; ``report`` is a folder for the results of every file.
    """
    watch.register(spark)
    top = files.full_path(spark, directory)
    tasks = str(2 * spark.sparkContext.defaultParallelism)
    found = spark.readStream.format("quarry_files").option("maxFileMb", str(max_file_mb)).option("tasks", tasks).option("contents", "false").load(top)
    name = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    collection.open_collection(spark, target)

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # names, times and sizes; contents are read once, when the documents are written
        listing = stored(files.crawl_files(spark, directory, max_file_mb=max_file_mb), "listing")
        known = collection.indexed_files(spark, target).withColumnRenamed("filepath", "path")
        late = listing.join(known, "path", "left_anti").join(batch.select("path"), "path", "left_anti")
        changed = batch.select("path", "length", "modificationTime").unionByName(late)
        others = changed.filter(~files.is_text()).withColumn("content", F.lit(None).cast("binary"))
        read = files.with_content(changed.filter(files.is_text()), gone=True).unionByName(others)
        gone = index.missing_files(spark, directory, target, listing)
        results = index.index_documents(index.documents_of(files.decoded(read)), target, part=f"{name}-{number:08d}", gone=gone, **settings)
        if report:
            results.write.mode("overwrite").parquet(f"{report.rstrip('/')}/{name}-{number:08d}")
        batch.unpersist()
        drop_stored(listing)
        drop_stored(results)

    return found.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
