"""Tables and folders that only live as long as a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}
_noted = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: the one named in ``spark.checkpoint.dir``.

    Where none is named, a session that runs in one process (tests, a laptop) gets a temporary folder of its own, and
    any other an error, for executors don't see the driver's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _made:
        _made[context.applicationId] = tempfile.mkdtemp(prefix="spark-quarry-")
    return _made[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has yet."""
    return f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"


#: For tables with a whole file's text in a row: groups of 16 MB, whose size is looked at after every row and not after a
#: hundred, so that neither writer nor reader holds a hundred texts; compressed better than Spark does by itself.
WIDE = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: made once, and no lost executor takes it away."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    for paths in getattr(_noted, "lists", []):
        paths.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quarry_path = path
    return back


def drop_path(spark: SparkSession, name: str) -> None:
    """Delete a file or folder wherever Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that no later step reads."""
    drop_path(df.sparkSession, df._quarry_path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Store what ``make`` returns, and delete the tables that were stored on the way to it in this thread."""
    paths: list[str] = []
    _noted.lists = [*getattr(_noted, "lists", []), paths]
    try:
        out = stored(make(), name)
    finally:
        _noted.lists = _noted.lists[:-1]
    for path in paths:
        if path != out._quarry_path:
            drop_path(spark, path)
    return out
