"""Listing and reading files of a directory tree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import base_name, suffix_of
from quarry.operators.text import PARSERS
from quarry.sources.scratch import stored

MAX_FILE_MB = 50
#: Parsers whose files are text; what others hold must be decoded before it is text.
TEXT_PARSERS = ("txt", "md")
#: Name endings of supported files, in lower case.
TREE_SUFFIXES = tuple(PARSERS)
LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modificationTime", T.TimestampType())])


def supported(path: str = "path", length: str = "length", max_file_mb: float = MAX_FILE_MB) -> Column:
    return suffix_of(F.col(path)).isin(*PARSERS) & (F.col(length) <= int(max_file_mb * 1024 * 1024))


def is_text(path: str = "path") -> Column:
    return suffix_of(F.col(path)).isin(*[suffix for suffix, parser in PARSERS.items() if parser in TEXT_PARSERS])


def filter_files(files: DataFrame, max_file_mb: float = MAX_FILE_MB) -> DataFrame:
    """Files of a supported type and of at most the given size, that size included."""
    return files.filter(supported(max_file_mb=max_file_mb))


def _folder(spark: SparkSession, directory: str) -> str:
    """The directory's full path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise FileNotFoundError(f"Directory not found: {directory}")
    if not system.getFileStatus(path).isDirectory():
        raise NotADirectoryError(f"Path is not a directory: {directory}")
    return system.makeQualified(path).toString()


def open_place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and place of a full path as Spark writes it (``file:/x``, ``hdfs://host/x``)."""
    scheme, _, rest = path.partition(":")
    return (pafs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else pafs.FileSystem.from_uri(path)


_SEEN = "path string, odd boolean, folder boolean, length long, modificationTime timestamp"


def _passed_over(spark: SparkSession, directory: str, recursive: bool) -> DataFrame:
    """Files that Spark's own file source passes over: names, or folders, that start with an underscore, and empty files.

    Folders are listed in tasks, level by level; only one count for each level comes to the driver. Stores are those
    that Arrow opens by their scheme.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, inside in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = open_place(folder)
                found = [f for f in system.get_file_info(pafs.FileSelector(place)) if not f.base_name.startswith(".")]
                odd = [inside or f.base_name.startswith("_") for f in found]
                folders = [f.type == pafs.FileType.Directory for f in found]
                times = pa.array([f.mtime_ns // 1000 for f in found], pa.timestamp("us", "UTC"))
                odd = [o or not (d or f.size) for o, d, f in zip(odd, folders, found)]
                arrays = [pa.array([f"{folder}/{f.base_name}" for f in found], pa.string()), pa.array(odd, pa.bool_()), pa.array(folders, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([f.size or 0 for f in found], pa.int64()), times], ["path", "odd", "folder", "length", "modificationTime"])

    level = spark.range(1).select(F.lit(directory.rstrip("/")).alias("path"), F.lit(False).alias("odd"))
    found = None
    while True:
        seen = stored(level.repartition("path").mapInArrow(look, _SEEN), "listing")
        files = seen.filter("odd AND NOT folder").select(*LISTING.names)
        found = files if found is None else found.unionByName(files)
        level = seen.filter("folder").select("path", "odd")
        if not recursive or level.isEmpty():
            return found


def with_details(paths: DataFrame) -> DataFrame:
    """``path, length, modificationTime`` of full paths; a null length where there is no such file."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                system, place = open_place(path)
                found.append(system.get_file_info(place))
            times = pa.array([f.mtime_ns // 1000 if f.is_file else None for f in found], pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.size for f in found], pa.int64()), times], LISTING.names)

    return paths.select("path").mapInArrow(look, LISTING)


def remove_files(paths: DataFrame) -> None:
    """Delete the files of ``path`` (full, with its scheme), in the tasks that have the rows."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = open_place(path)
                system.delete_file(place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    paths.select("path").mapInArrow(remove, "n long").agg(F.sum("n")).first()


def with_content(files: DataFrame, gone: bool = False) -> DataFrame:
    """Adds ``content`` by reading each file in the task that has its row; with ``gone``, files that are no longer there have no row."""
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                system, place = open_place(row.column("path")[0].as_py())
                try:
                    with system.open_input_stream(place) as stream:
                        content = stream.read()
                except FileNotFoundError:
                    if not gone:
                        raise
                    continue
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], schema.names)

    # By number: where it is left to Spark, tasks are put together by the bytes of their paths, and one reads all contents.
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(read, schema)


def write_files(files: DataFrame) -> None:
    """Write a file for each row of ``path`` (full, with its scheme) and ``content``, in the task that has the row."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                system, place = open_place(path.as_py())
                system.create_dir(place.rpartition("/")[0])
                with system.open_output_stream(place) as stream:
                    stream.write(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    files.select("path", F.col("content").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).first()


def full_path(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _visible(spark: SparkSession, directory: str, recursive: bool) -> DataFrame:
    """What Spark's file source sees, but for hidden names below the directory."""
    top = _folder(spark, directory)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not recursive:
        reader = reader.option("pathGlobFilter", "[!.]*")
    # Spark gives a full path; only what lies below the directory is tested for hidden names.
    below = F.replace(F.col("path"), F.lit(top), F.lit(""))
    return reader.load(directory).filter(~below.rlike(r"/\."))


def list_files(spark: SparkSession, directory: str, recursive: bool = True, hidden: bool = True) -> DataFrame:
    """All visible files below ``directory``: ``path, length, modificationTime``. No content is read.

    Names that start with a dot are skipped, folders with such names too. ``hidden`` adds the files that Spark
    hides. A missing directory or one that is a file is an error at once.
    """
    listed = _visible(spark, directory, recursive).select(*LISTING.names)
    return listed.unionByName(_passed_over(spark, _folder(spark, directory), recursive)) if hidden else listed


def crawl_files(spark: SparkSession, directory: str, recursive: bool = True, max_file_mb: float = MAX_FILE_MB, hidden: bool = True) -> DataFrame:
    """Supported files below ``directory``."""
    return filter_files(list_files(spark, directory, recursive, hidden), max_file_mb)


def file_info(files: DataFrame) -> DataFrame:
    """``path, name, extension, size, modified``."""
    return files.select("path", base_name(F.col("path")).alias("name"), suffix_of(F.col("path")).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def decode_text(content: Column) -> tuple[Column, Column]:
    """Text and encoding of a file's bytes: UTF-8 where valid, else Latin-1; no mark at the start, line ends as ``\\n``."""
    valid = F.is_valid_utf8(content.cast("string"))
    bom = F.substring(F.hex(F.substring(content, 1, 3)), 1, 6) == "EFBBBF"
    text = F.when(valid, content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    text = F.when(valid & bom, F.substring(text, 2, 1 << 30)).otherwise(text)
    return F.regexp_replace(text, "\r\n?", "\n"), F.when(valid & bom, "utf-8-sig").when(valid, "utf-8").otherwise("latin-1")


def texts_and_others(spark: SparkSession, directory: str, recursive: bool = True, max_file_mb: float = MAX_FILE_MB, hidden: bool = True) -> tuple[DataFrame, DataFrame]:
    """The files that :func:`crawl_files` lists: those that are text, with ``content``, and a listing of the others.

    Size and type are tested before anything is read.
    """
    fits = supported(max_file_mb=max_file_mb)
    seen = _visible(spark, directory, recursive).filter(fits)
    texts, others = seen.filter(is_text()).select(*LISTING.names, "content"), seen.filter(~is_text()).select(*LISTING.names)
    if hidden:
        more = _passed_over(spark, _folder(spark, directory), recursive).filter(fits)
        texts, others = texts.unionByName(with_content(more.filter(is_text()))), others.unionByName(more.filter(~is_text()))
    return texts, others


def read_files(spark: SparkSession, directory: str, recursive: bool = True, max_file_mb: float = MAX_FILE_MB, hidden: bool = True) -> DataFrame:
    """The files that :func:`crawl_files` lists, with ``content``, but for types that are no text, whose content stays null."""
    texts, others = texts_and_others(spark, directory, recursive, max_file_mb, hidden)
    return texts.unionByName(others.withColumn("content", F.lit(None).cast("binary")))


def read_text(spark: SparkSession, directory: str, recursive: bool = True, max_file_mb: float = MAX_FILE_MB, hidden: bool = True) -> DataFrame:
    """``path, length, modificationTime, text, encoding`` of the text files among those that :func:`crawl_files` lists."""
    return decoded(read_files(spark, directory, recursive, max_file_mb, hidden).filter(is_text()))


def decoded(files: DataFrame) -> DataFrame:
    text, encoding = decode_text(F.col("content"))
    return files.select("path", "length", "modificationTime", text.alias("text"), encoding.alias("encoding"))
