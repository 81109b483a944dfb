"""WARC archives: writing captures with revisit records, reading archives back, and one ordered index of all captures.

Writing is Spark expressions and the text writer, whose line separator is the blank line that ends a record, so archives
go to any file system Spark writes to, and a lost executor's files are never half there. Reading splits the gzipped
files at blank lines and puts records together again by their lengths, one stream for each file.

The index is an external merge. A reading task sorts the captures of its files by URL key and timestamp in runs of
RUN_ROWS; runs are cut where ranges of keys begin, and packed in blocks of BLOCK_ROWS captures. Blocks meet by range and
come in order of their first keys, so a task merges any number of runs by a loser tree while it holds one block of each
run that overlaps the place it has come to. The ranges together are the captures of all archives in order: the history
of each URL, one capture after another.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import itertools
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop_stored, join_spread, stored, table, utf8
from quarry.sources.scratch import drop_path, scratch_path

#: A payload of fewer bytes is always stored.
MIN_REVISIT_BYTES = 1000
RECORDS_PER_FILE, RUN_ROWS, BLOCK_ROWS = 20_000, 50_000, 1000
BLANK_LINE = "\r\n\r\n"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
DATE = "2000-01-01T00:00:00Z"


def _header_value(c: Column) -> Column:
    """White space and control signs percent-encoded, so that a header stays one line."""
    coded = lambda x: F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(x)), 2, "0"))
    signs = F.transform(F.split(c, ""), lambda x: F.when(x.rlike(r"[\x00-\x20\x7F]"), coded(x)).otherwise(x))
    return F.when(c.rlike(r"[\x00-\x20\x7F]"), F.array_join(signs, "")).otherwise(c)


def with_records(captures: DataFrame) -> DataFrame:
    """``captures`` (``id, url, date, payload, digest, refers_to``) with ``record``: the WARC record without its last blank line."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    name = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(F.url_encode(c), F.lit("")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(BLANK_LINE))
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\n"),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Target-URI", _header_value(F.col("url"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, name(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
    )
    return captures.withColumn("record", F.concat(head.cast("binary"), http.cast("binary"), body))


def revisits(captures: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``id, same, refers_to`` of captures whose payload another one with a larger id has: ids and hashes only.

    ``captures`` has ``id``, ``same`` (SHA-256 of the payload) and ``size``. Null ids count as the smallest. Rows that
    repeat an id and a payload are one here; among them none is chosen, so all of the largest id stay responses.
    """
    large = captures.filter(F.col("size") >= min_bytes).select("id", "same")
    groups = stored(large.groupBy("same").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("rows")).filter("rows > 1 AND refers_to IS NOT NULL"), "payloads")
    total = groups.agg(F.sum("rows")).first()[0] or 0
    found = join_spread(large, groups, ["same"], "rows", total)
    found = stored(found.filter("id IS NULL OR id < refers_to").distinct(), "revisits")
    drop_stored(groups)
    return found


def write_warc(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str | None = None, min_bytes: int = MIN_REVISIT_BYTES
) -> None:
    """Write a record for every row of ``pages`` to gzipped archives in the folder ``path``.

    Of equal payloads of at least ``min_bytes`` the row with the largest ``key`` is a response and the others are
    revisits of it, without the payload; rows that repeat that key and payload are all responses. A null ``html`` is an empty payload, a null ``url`` leaves
    its header out, a null key is an empty one. ``date`` names a column of timestamps as text (ISO 8601); without it, all
    records bear the same one. A payload is a row, so it is bounded by what a row can hold; other columns are never read.
    """
    when = F.coalesce(_header_value(F.col(date).cast("string")), F.lit(DATE)) if date else F.lit(DATE)
    payload = F.col(html) if dict(pages.dtypes)[html] == "binary" else utf8(html)
    captures = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), when.alias("date"), F.coalesce(payload, F.lit("").cast("binary")).alias("payload"))
    captures = captures.withColumn("size", F.octet_length("payload")).withColumn("same", F.when(F.col("size") >= min_bytes, F.sha2("payload", 256)))
    found = revisits(captures, min_bytes)
    again = found.select(F.col("id").alias("by"), F.col("same").alias("of"), "refers_to")
    captures = captures.join(again, F.col("id").eqNullSafe(F.col("by")) & (F.col("same") == F.col("of")), "left")
    records = with_records(captures.select("id", "url", "date", "payload", F.sha1("payload").alias("digest"), "refers_to"))
    out = records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", BLANK_LINE)
    out.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    drop_stored(found)


def url_key(url: str | None) -> str:
    """The sort key of a URL: host names from the last to the first, then path and query, without scheme and in lower case."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, _, port = rest[:cut].rpartition("@")[2].partition(":")
    name = ",".join(reversed(host.lower().removeprefix("www.").split(".")))
    tail = rest[cut:].partition("#")[0].lower()
    return f"{name}{':' + port if port not in ('', '80', '443') else ''}){tail if tail.startswith('/') else '/' + tail}"


def _file_records(file: str, pieces: Iterator[bytes]) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """``file, offset, headers, block`` of every record of a stream that was split at blank lines."""
    blank, data, offset = BLANK_LINE.encode(), b"", 0
    while True:
        while True:
            offset += len(data) - len(data.lstrip(b"\r\n"))
            data = data.lstrip(b"\r\n")
            end = data.find(blank)
            if end >= 0:
                break
            piece = next(pieces, None)
            if piece is None:
                return
            data += piece + blank
        if not data.startswith(b"WARC/"):
            raise ValueError(f"{file} has no record at {offset}")
        lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start = end + len(blank)
        stop = start + int(headers.get("content-length", 0))
        parts, size = [data], len(data)
        while size < stop:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError(f"{file} ends within the record at {offset}")
            parts += [piece, blank]
            size += len(piece) + len(blank)
        data = b"".join(parts)
        yield file, offset, headers, data[start:stop]
        data, offset = data[stop:], offset + stop


def _records(pieces: Iterable[tuple[str, bytes]]) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    for file, own in itertools.groupby(pieces, key=lambda p: p[0]):
        yield from _file_records(file, (piece for _, piece in own))


def _page(record_id: str | None) -> str | None:
    """The id in a record's name; null in those of other writers and of pages without one."""
    found = re.fullmatch(f"<{RECORD_ID}(.+)>", record_id or "")
    return unquote(found[1].replace("+", " ")) if found else None


_CAPTURE = pa.schema([("key", pa.binary()), ("url", pa.string()), ("date", pa.string()), ("page", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
                      ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("intact", pa.bool_())])
_CAPTURE_DDL = "key binary, url string, date string, page string, file string, offset long, record_type string, payload_bytes long, payload_digest string, refers_to string, intact boolean"


def _capture(file: str, offset: int, headers: dict[str, str], block: bytes) -> dict | None:
    """The index entry of a response or revisit; None for records of other kinds."""
    kind = headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(BLANK_LINE.encode())
    said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size, digest = int(length[1]) if length else None, said or None
    url, date, page = headers.get("warc-target-uri"), headers.get("warc-date"), _page(headers.get("warc-record-id"))
    key = b"\0".join(x.encode("utf-8", "replace") for x in (url_key(url), date or "", (page or "").rjust(20), file, f"{offset:020d}"))
    return {"key": key, "url": url, "date": date, "page": page, "file": file, "offset": offset, "record_type": kind, "payload_bytes": size,
            "payload_digest": digest, "refers_to": _page(headers.get("warc-refers-to")), "intact": not said or digest == said}


_BLOCK_DDL = "first binary, last binary, n int, block binary"


def _read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Captures of the files of a task in sorted runs, in packed blocks."""
    pieces = (row for batch in batches for row in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()))
    entries = (entry for record in _records(pieces) if (entry := _capture(*record)) is not None)
    while run := list(itertools.islice(entries, RUN_ROWS)):
        run.sort(key=lambda e: e["key"])
        for at in range(0, len(run), BLOCK_ROWS):
            yield _block(pa.Table.from_pylist(run[at : at + BLOCK_ROWS], schema=_CAPTURE))


def _block(rows: pa.Table) -> pa.RecordBatch:
    keys = rows.column("key")
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return pa.record_batch({"first": [keys[0].as_py()], "last": [keys[-1].as_py()], "n": pa.array([len(rows)], pa.int32()), "block": [out.getvalue()]})


def _unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


class LoserTree:
    """Merges sorted blocks: the least head of all is at the root, and the loser of each match stays where it was played."""

    def __init__(self) -> None:
        self.sources: list[tuple[list[bytes], pa.Table]] = []
        self.at: list[int] = []
        self.losers: list[int] = []
        self.winner = -1

    def head(self, leaf: int) -> bytes | None:
        """None comes after all keys: the block has ended."""
        if leaf >= len(self.sources) or self.at[leaf] >= len(self.sources[leaf][0]):
            return None
        return self.sources[leaf][0][self.at[leaf]]

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head(a), self.head(b)
        return y is None or (x is not None and (x, a) < (y, b))

    def add(self, rows: pa.Table) -> None:
        """A further block; ended ones are left out, and all matches are played again."""
        live = [i for i in range(len(self.sources)) if self.head(i) is not None]
        self.sources, self.at = [self.sources[i] for i in live], [self.at[i] for i in live]
        self.sources.append((rows.column("key").to_pylist(), rows))
        self.at.append(0)
        leaves = 1 << max(0, len(self.sources) - 1).bit_length()
        winners = [0] * leaves + list(range(leaves))
        self.losers = [0] * leaves
        for node in range(leaves - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1]

    def least(self) -> bytes | None:
        return self.head(self.winner) if self.sources else None

    def pop(self) -> tuple[pa.Table, int]:
        """The block and row of the least key; its leaf then plays its way up again."""
        leaf = self.winner
        out = self.sources[leaf][1], self.at[leaf]
        self.at[leaf] += 1
        node = (leaf + len(self.losers)) >> 1
        while node:
            if self._beats(self.losers[node], leaf):
                leaf, self.losers[node] = self.losers[node], leaf
            node >>= 1
        self.winner = leaf
        return out


def merged(blocks: Iterable[tuple[bytes, bytes]]) -> Iterator[tuple[pa.Table, int]]:
    """Rows (a table and a place in it) of packed blocks in order of their keys; blocks come in order of their first keys."""
    tree = LoserTree()
    for first, block in blocks:
        while (least := tree.least()) is not None and least < first:
            yield tree.pop()
        tree.add(_unpacked(block))
    while tree.least() is not None:
        yield tree.pop()


def _gathered(places: list[tuple[pa.Table, int]]) -> pa.Table:
    before, tables, size, rows = {}, [], 0, []
    for rows_of, i in places:
        if id(rows_of) not in before:
            before[id(rows_of)] = size
            tables.append(rows_of)
            size += len(rows_of)
        rows.append(before[id(rows_of)] + i)
    return pa.concat_tables(tables).take(pa.array(rows, pa.int64()))


_ORDERED_DDL = f"range int, nth long, {_CAPTURE_DDL}"


def _merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("range", "first", "block"))))
    for number, own in itertools.groupby(blocks, key=lambda row: row[0]):
        rows, start = merged((first, block) for _, first, block in own), 0
        while places := list(itertools.islice(rows, 10_000)):
            kept = _gathered(places)
            at = pa.table({"range": pa.array([number] * len(places), pa.int32()), "nth": pa.array(range(start, start + len(places)), pa.int64())})
            start += len(places)
            for name in _CAPTURE.names:
                at = at.append_column(name, kept.column(name))
            yield from at.combine_chunks().to_batches()


def _cut_blocks(bounds: list[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the number of their range; those that reach over a bound are cut there."""
    for batch in batches:
        for first, last, n, block in zip(*(batch.column(c).to_pylist() for c in ("first", "last", "n", "block"))):
            low, high = bisect.bisect_right(bounds, first), bisect.bisect_right(bounds, last)
            if low == high:
                parts = [(low, first, block)]
            else:
                rows, parts, at = _unpacked(block), [], 0
                keys = rows.column("key").to_pylist()
                for number in range(low, high + 1):
                    end = bisect.bisect_left(keys, bounds[number]) if number < high else n
                    if end > at:
                        parts.append((number, keys[at], _block(rows.slice(at, end - at)).column("block")[0].as_py()))
                    at = end
            yield pa.record_batch({"range": pa.array([p[0] for p in parts], pa.int32()), "first": [p[1] for p in parts], "block": [p[2] for p in parts]})


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``range, nth`` and the captures of all archives under ``path``, in order of URL key, timestamp, page, file and place.

    The order is that of ``range`` and then ``nth``. ``page`` and ``refers_to`` are the ids that :func:`write_warc` put into
    the names of records, as text. ``payload_bytes`` and ``payload_digest`` are taken from the payload itself, for a
    revisit from its headers; ``intact`` is whether the payload has the digest that its record states. Records of other
    kinds are passed over; a file that ends within a record, or holds something else, is an error. A folder without
    records gives no rows. Captures are stored beside the result when this returns, so the archives may go then. A file is read by one task as a stream, and a record is held whole.
    """
    lines = spark.read.option("lineSep", BLANK_LINE).text(path)
    files = lines.select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("value"))
    runs = stored(files.mapInArrow(_read_runs, _BLOCK_DDL), "runs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.spark_partition_id()
    firsts = runs.select("first").repartitionByRange(parts, "first").groupBy(at.alias("part")).agg(F.min("first").alias("first"))
    bounds = [bytes(r["first"]) for r in firsts.orderBy("first").collect()][1:]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut_blocks(bounds, batches)

    blocks = runs.mapInArrow(cut, "range int, first binary, block binary")
    met = blocks.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "first")
    return met.mapInArrow(_merge_ranges, _ORDERED_DDL)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    index = read_index(spark, path)
    drop_path(spark, path)
    return index.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT t, max(page_id) AS keep FROM p WHERE n >= {MIN_REVISIT_BYTES} GROUP BY t)
SELECT page_id, n AS payload_bytes, sha1(p.t) AS payload_digest,
       CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keep THEN keep END AS refers_to
FROM p LEFT JOIN k ON p.t = k.t AND n >= {MIN_REVISIT_BYTES}
"""
