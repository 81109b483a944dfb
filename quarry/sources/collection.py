"""A collection: chunks, vectors and metadata as Parquet files under snapshots.

A batch of chunks is written to a folder of its own, and is part of the collection once a snapshot names it. A snapshot is
one small file that is made at one go, numbered behind the last; a writer that finds its number taken adds its change to
the newer snapshot and tries the next. So readers see a batch as a whole or not at all, and a job that is lost half-way
leaves nothing but a folder that no snapshot names (:func:`vacuum` removes those).

Beside its chunks a batch has the list of its files, and a list of those older batches' files that it replaces and of its
own that are left out, as they lack vectors; their chunks are passed over when the collection is read, by an anti-join that
collections without such files don't need. :func:`compact` writes what is left as one batch.

Metadata is a map of strings, which Parquet cannot search. Keys that are to be searched are promoted to typed columns when
the collection is made.
"""

from __future__ import annotations

import functools
import json
import operator
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.scratch import drop_path, stored

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("filepath", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("document", T.StringType()),
        T.StructField("start_index", T.IntegerType()),
        T.StructField("end_index", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


_MISMATCH = "counts differ"


class CountMismatch(ValueError):
    """Chunks and vectors that do not pair up."""


#: Promoted keys are columns of this name and the key.
PROMOTED = "meta_"
_KEYS = "filepath string, batch string"
#: How chunks are written: a chunk's text is there twice, as its document and in its metadata.
_PACKED = {"compression": "zstd"}


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    system, place = _place(spark, path)
    return [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []


def _snapshot(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The number that the next snapshot may take no less than, and the last whole snapshot."""
    numbers = sorted((int(n.split(".")[0]) for n in _names(spark, f"{path}/_snapshots") if n.endswith(".json")), reverse=True)
    for number in numbers:
        system, place = _place(spark, f"{path}/_snapshots/{number:010d}.json")
        stream = system.open(place)
        try:
            return numbers[0] + 1, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # its writer was lost
            continue
        finally:
            stream.close()
    return (numbers[0] + 1 if numbers else 0), None


def _commit(spark: SparkSession, path: str, change: Callable[[dict], dict]) -> None:
    """Make the snapshot that ``change`` makes of the last one."""
    while True:
        number, last = _snapshot(spark, path)
        made = json.dumps(change(last or {"promoted": {}, "batches": []}))
        system, place = _place(spark, f"{path}/_snapshots/{number:010d}.json")
        try:
            stream = system.create(place, False)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                continue
            raise
        stream.write(made.encode())
        stream.close()
        return


def _schema(promoted: dict[str, str]) -> T.StructType:
    more = [T.StructField(PROMOTED + key, T.StructType.fromDDL(f"x {kind}")[0].dataType) for key, kind in promoted.items()]
    return T.StructType([*SCHEMA.fields, *more])


def _read(spark: SparkSession, path: str, kind: str, batches: list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of the named batches, with ``batch``."""
    whole = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    whole = whole if "batch" in whole.names else T.StructType([*whole.fields, T.StructField("batch", T.StringType())])
    if not batches:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/batch={b}" for b in batches])


def _live(spark: SparkSession, path: str, kind: str, snapshot: dict, schema: T.StructType | str) -> DataFrame:
    rows = _read(spark, path, kind, [b["name"] for b in snapshot["batches"]], schema)
    # A file that its batch leaves out has no chunks, but is known to the collection.
    replaced = [b["name"] for b in snapshot["batches"] if b["replaces"] or (kind == "data" and b.get("left_out"))]
    if not replaced:
        return rows
    dead = _read(spark, path, "replaced", replaced, "filepath string, old string")
    dead = dead if kind == "data" else dead.filter("old <> batch")
    dead = dead.select("filepath", F.col("old").alias("batch")).distinct()
    return rows.join(dead, ["filepath", "batch"], "left_anti")


def open_collection(spark: SparkSession, path: str, reset: bool = False, promoted: dict[str, str] | None = None) -> DataFrame:
    """The collection at ``path`` as it is now, made empty if there is none; ``reset`` empties it.

    ``promoted`` names metadata keys and their types (``{"lang": "string"}``); it holds for a collection from when it is
    made or reset. What is read later on is the snapshot of this moment, also if others write.
    """
    path = path.rstrip("/")
    if reset or _snapshot(spark, path)[1] is None:
        _commit(spark, path, lambda last: {"promoted": promoted if promoted is not None else last["promoted"], "batches": []})
    snapshot = _snapshot(spark, path)[1]
    schema = _schema(snapshot["promoted"])
    return _live(spark, path, "data", snapshot, schema).select(*schema.names)


def indexed_files(spark: SparkSession, path: str) -> DataFrame:
    """``filepath`` of the files that the collection has been given, those without chunks too."""
    snapshot = _snapshot(spark, path.rstrip("/"))[1] or {"batches": []}
    return _live(spark, path.rstrip("/"), "files", snapshot, _KEYS).select("filepath").distinct()


def metadata_equals(collection: DataFrame, wanted: dict[str, object]) -> Column:
    """Whether a row's metadata has the given values: by typed columns, which reach the Parquet scan, for promoted keys."""
    tests = [F.col(PROMOTED + key) == value if PROMOTED + key in collection.columns else F.col("metadata")[key] == str(value) for key, value in wanted.items()]
    return functools.reduce(operator.and_, tests, F.lit(True))


def store_chunks(
    chunks: DataFrame, path: str, vectors: DataFrame | None = None, skip_existing: bool = False, part: str | None = None, replacing: DataFrame | None = None,
    encode: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Append ``chunks`` to the collection, as a whole or not at all.

    ``vectors`` (``filepath, chunk_index, embedding``) are paired with chunks by place unless chunks have their own.
    A chunk without a vector, or a vector without a chunk, is an error and nothing is stored: the check is part of the
    write, so vectors are made once. Appending again stores again, unless ``skip_existing`` leaves out chunks that are
    there: those of the same id, path, place and text, for ids alone can be equal by chance. ``encode`` adds
    ``embedding`` to chunks that have none, to those only that are to be stored. ``replacing`` has the
    ``filepath`` of files that this batch is about: what was stored of them before goes, also where they have no chunks
    now. ``part`` names a batch: stored again it replaces the batch of that name.
    """
    spark, path = chunks.sparkSession, path.rstrip("/")
    rows = chunks
    if vectors is not None:
        marked = chunks.drop("embedding").withColumn("__chunk", F.lit(True))
        rows = marked.join(vectors.select("filepath", "chunk_index", "embedding"), ["filepath", "chunk_index"], "full_outer")
        missing = F.raise_error(F.lit(f"{_MISMATCH}: a vector without a chunk")).cast("array<double>")
        rows = rows.withColumn("embedding", F.when(F.col("__chunk").isNull(), missing).otherwise(F.col("embedding")))
    present = open_collection(spark, path)
    if skip_existing:
        sign = lambda df: [F.col(c) if c in df.columns else F.lit(None) for c in ("id", "filepath", "chunk_index", "document")]
        digest = lambda df: F.sha2(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(sign(df))])), 256).alias("__sign")
        rows = rows.withColumn("__sign", digest(rows)).join(present.select(digest(present)), "__sign", "left_anti").drop("__sign")
    rows = encode(rows) if encode is not None else rows
    missing = F.raise_error(F.lit(f"{_MISMATCH}: a chunk without a vector")).cast("array<double>")
    rows = rows.withColumn("embedding", F.coalesce(F.col("embedding"), missing))
    try:
        name = _write(rows, path)
    except Exception as error:
        if _MISMATCH in str(error):
            raise CountMismatch(str(error).partition(_MISMATCH)[2].strip(": ").splitlines()[0]) from error
        raise
    _add_batch(spark, path, name, part, replacing)


def store_files(chunks: DataFrame, path: str, replacing: DataFrame, part: str | None = None) -> DataFrame:
    """Append the chunks of whole files; how many chunks and vectors each has (``filepath, n, m``).

    A file with a chunk that has no vector is left out as a whole. That is known when all its chunks are there, so they
    are written to the batch once, like the others, and the batch names the file as one whose chunks are not to be read.
    ``replacing`` and ``part`` are those of :func:`store_chunks`.
    """
    spark, path = chunks.sparkSession, path.rstrip("/")
    open_collection(spark, path)
    name = _write(chunks, path)
    written = spark.read.schema(SCHEMA).parquet(f"{path}/data/batch={name}")
    counts = stored(written.groupBy("filepath").agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("m")), "counts")
    _add_batch(spark, path, name, part, replacing, counts.filter("n <> m").select("filepath"))
    return counts


def _write(rows: DataFrame, path: str) -> str:
    """Write ``rows`` to the folder of a new batch, with the collection's columns; the batch's name."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA.fields]
    promoted = _snapshot(rows.sparkSession, path)[1]["promoted"]
    typed = [F.col("metadata")[key].try_cast(kind).alias(PROMOTED + key) for key, kind in promoted.items()]
    name = uuid.uuid4().hex
    rows.select(*columns).select("*", *typed).write.options(**_PACKED).parquet(f"{path}/data/batch={name}")
    return name


def _add_batch(spark: SparkSession, path: str, name: str, part: str | None, replacing: DataFrame | None, left_out: DataFrame | None = None) -> None:
    """Name a written batch in a snapshot, with its files, the older ones that it replaces and those that it leaves out."""
    own = spark.read.schema("filepath string").parquet(f"{path}/data/batch={name}")
    if replacing is not None:
        own = own.unionByName(replacing.select(F.col("filepath").cast("string").alias("filepath")))
    own.distinct().write.parquet(f"{path}/files/batch={name}")
    files = spark.read.schema("filepath string").parquet(f"{path}/files/batch={name}")

    def change(last: dict) -> dict:
        others = [b for b in last["batches"] if part is None or b["part"] != part]
        gone = []
        if replacing is not None and others:
            gone.append(_read(spark, path, "files", [b["name"] for b in others], _KEYS).join(files, "filepath", "left_semi").withColumnRenamed("batch", "old"))
        if left_out is not None:
            gone.append(left_out.select("filepath", F.lit(name).alias("old")))
        marks = {"replaces": False, "left_out": False}
        if gone:
            functools.reduce(DataFrame.unionByName, gone).write.mode("overwrite").parquet(f"{path}/replaced/batch={name}")
            listed = _read(spark, path, "replaced", [name], "filepath string, old string")
            own = F.col("old") == name
            marks = listed.agg(F.coalesce(F.bool_or(~own), F.lit(False)).alias("replaces"), F.coalesce(F.bool_or(own), F.lit(False)).alias("left_out")).first().asDict()
        return last | {"batches": [*others, {"name": name, "part": part, **marks}]}

    _commit(spark, path, change)


def compact(spark: SparkSession, path: str) -> None:
    """Write what the collection holds as one batch without replaced chunks. A batch that is added meanwhile stays as it is."""
    path = path.rstrip("/")
    before = _snapshot(spark, path)[1]
    if before is None or not before["batches"]:
        return
    name, old = uuid.uuid4().hex, {b["name"] for b in before["batches"]}
    schema = _schema(before["promoted"])
    _live(spark, path, "data", before, schema).select(*schema.names).write.options(**_PACKED).parquet(f"{path}/data/batch={name}")
    _live(spark, path, "files", before, _KEYS).select("filepath").distinct().write.parquet(f"{path}/files/batch={name}")

    def change(last: dict) -> dict:
        if not old <= {b["name"] for b in last["batches"]}:
            raise RuntimeError("the collection was changed by another job; compact it again")
        newer = [b for b in last["batches"] if b["name"] not in old]
        if any(b["replaces"] for b in newer):
            raise RuntimeError("the collection was changed by another job; compact it again")
        return last | {"batches": [{"name": name, "part": None, "replaces": False}, *newer]}

    _commit(spark, path, change)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders that the last snapshot doesn't name, and older snapshots; how many. Only while nobody writes or reads an older one."""
    path = path.rstrip("/")
    number, last = _snapshot(spark, path)
    named = {f"batch={b['name']}" for b in (last or {"batches": []})["batches"]}
    gone = [f"{path}/{kind}/{n}" for kind in ("data", "files", "replaced") for n in _names(spark, f"{path}/{kind}") if n not in named]
    gone += [f"{path}/_snapshots/{n}" for n in _names(spark, f"{path}/_snapshots") if n.endswith(".json") and int(n.split(".")[0]) < number - 1]
    for folder in gone:
        drop_path(spark, folder)
    return len(gone)


def collection_count(collection: DataFrame) -> DataFrame:
    return collection.agg(F.count(F.lit(1)).alias("count"))
