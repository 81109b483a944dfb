"""A streaming source of files: new and changed ones, in the order of their times, whatever their names."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarry.sources.files import TREE_SUFFIXES, open_place

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
LISTED = "path string, modificationTime timestamp, length long"
#: Bytes and files that one task reads at most; fewer where there are more tasks than that would make. Only files count where no contents are read.
TASK_BYTES, TASK_FILES = 64 << 20, 1000


def _contents(options: dict) -> bool:
    return str(options.get("contents", "true")).lower() != "false"


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str, int]]):
        super().__init__(None)
        self.files = files


class _Reader(DataSourceStreamReader):
    """Offsets are the time and path of the newest file, and a digest of the listing, which tells that a file has gone.

    A listing is made where the stream is driven: names, times and sizes only. Contents are read in tasks.
    """

    def __init__(self, options: dict):
        self.top, self.most = options["path"].rstrip("/"), int(float(options.get("maxFileMb", 50)) * 1024 * 1024)
        self.tasks, self.contents = int(options.get("tasks", 1)), _contents(options)

    def _listing(self) -> list[tuple[int, str, int]]:
        import pyarrow.fs as pafs

        system, place = open_place(self.top)
        found = []
        for f in system.get_file_info(pafs.FileSelector(place, recursive=True)):
            below = f.path[len(place) :].lstrip("/")
            if f.is_file and f.size <= self.most and f.path.lower().endswith(TREE_SUFFIXES) and not any(name.startswith(".") for name in below.split("/")):
                found.append((f.mtime_ns // 1000, f"{self.top}/{below}", f.size))
        return sorted(found)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": "", "listing": ""}

    def latestOffset(self) -> dict:
        found = self._listing()
        time, path, _ = found[-1] if found else (-1, "", 0)
        return {"time": time, "path": path, "listing": hashlib.sha256(json.dumps(found).encode()).hexdigest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts, size = [_Files([])], 0
        fresh = [f for f in self._listing() if (start["time"], start["path"]) < f[:2] <= (end["time"], end["path"])]
        most, number = min(TASK_BYTES, sum(f[2] for f in fresh) // self.tasks), min(TASK_FILES, 1 + len(fresh) // self.tasks)
        for time, path, length in fresh:
            if parts[-1].files and ((self.contents and size + length > most) or len(parts[-1].files) >= number):
                parts, size = [*parts, _Files([])], 0
            parts[-1].files.append((time, path, length))
            size += length
        return parts

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        """A batch for each file with its content, so a task holds one file's; all files in one where no contents are read."""
        moments = pa.timestamp("us", "UTC")
        if not self.contents and partition.files:
            times, paths, lengths = zip(*partition.files)
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(times, moments), pa.array(lengths, pa.int64())], names=["path", "modificationTime", "length"])
        for time, path, length in partition.files if self.contents else ():
            system, place = open_place(path)
            try:
                with system.open_input_stream(place) as stream:
                    content = stream.read()
            except FileNotFoundError:  # it went since it was listed
                continue
            arrays = [pa.array([path], pa.string()), pa.array([time], moments), pa.array([length], pa.int64()), pa.array([content], pa.binary())]
            yield pa.record_batch(arrays, names=["path", "modificationTime", "length", "content"])

    def commit(self, end: dict) -> None:
        pass


class FileSource(DataSource):
    """``spark.readStream.format("quarry_files").load(directory)``: a row for each file of a supported type that is new or
    changed, names with an underscore and empty files among them; names, and folders, that start with a dot are skipped.
    With the option ``contents`` set to false, files are listed and not read."""

    @classmethod
    def name(cls) -> str:
        return "quarry_files"

    def schema(self) -> str:
        return SCHEMA if _contents(self.options) else LISTED

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSource)
