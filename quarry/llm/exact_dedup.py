"""Exact deduplication by composable polynomial fingerprints.

A text is read as little-endian 32-bit words ``w_0 .. w_{n-1}`` (the last one padded with zero bytes); its
fingerprint is ``sum(w_i * r**i) mod p`` for two primes, beside its length in bytes. Chunks of 64 KiB are hashed on
their own and combined by length-shifted arithmetic, ``H(A + B) = H(A) + r**words(A) * H(B)``. A huge document's pieces
are hashed by many tasks and combined by Spark (:func:`combine_chunks`).

Rows with equal fingerprints form a class. Every member is then compared with the class's kept document chunk by
chunk in one streaming pass; members that differ (a fingerprint collision) are put into classes of their own and
compared again, until no difference is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop_stored, join_spread, stored, table, utf8

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525)
CHUNK_BYTES = 65536
#: Longer texts are hashed in pieces by many tasks.
HUGE_BYTES, PIECE_BYTES = 1 << 22, 1 << 20
MEMBERS_PER_TASK_GROUP = 500


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    for i in range(1, n):
        out[i] = int(out[i - 1]) * base % prime
    return out


class Fingerprinter:
    """Hashes many texts at once; each text's chunks are hashed apart and then combined."""

    def __init__(self, primes: tuple[int, int] = PRIMES, chunk_bytes: int = CHUNK_BYTES):
        if chunk_bytes % 4:
            raise ValueError("chunk_bytes must be a multiple of 4")
        self.primes, self.words = primes, chunk_bytes // 4
        self.tables = [_powers(b % p, p, self.words) for b, p in zip(BASES, primes)]
        self.shifts = [pow(b % p, self.words, p) for b, p in zip(BASES, primes)]

    def chunk_hashes(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Chunks per text, and for either prime the hashes of all chunks in order."""
        n_words = np.array([(len(t) + 3) // 4 for t in texts], dtype=np.int64)
        joined = np.frombuffer(b"".join(t + b"\0" * (-len(t) % 4) for t in texts), dtype="<u4").astype(np.uint64)
        chunks = (n_words + self.words - 1) // self.words
        total = int(chunks.sum())
        if not total:
            return chunks, [np.zeros(0, dtype=np.uint64)] * 2
        owner = np.repeat(np.arange(len(texts)), chunks)
        order = np.arange(total) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        starts = (np.cumsum(n_words) - n_words)[owner] + order * self.words
        ends = np.append(starts[1:], len(joined))
        inside = np.arange(len(joined)) - np.repeat(starts, ends - starts)
        hashes = []
        for p, powers in zip(self.primes, self.tables):
            terms = joined % np.uint64(p) * powers[inside] % np.uint64(p)
            hashes.append(np.add.reduceat(terms, starts) % np.uint64(p))
        return chunks, hashes

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Fingerprints of whole texts, combined from their chunks' hashes."""
        chunks, hashes = self.chunk_hashes(texts)
        firsts = np.cumsum(chunks) - chunks
        out = []
        for p, shift, h in zip(self.primes, self.shifts, hashes):
            got = np.zeros(len(texts), dtype=np.int64)
            one = chunks == 1
            got[one] = h[firsts[one]].astype(np.int64)
            for i in np.flatnonzero(chunks > 1):
                value = 0
                for x in h[firsts[i] : firsts[i] + chunks[i]][::-1].tolist():
                    value = (value * shift + x) % p
                got[i] = value
            out.append(got)
        return out


def combine_chunks(chunks: DataFrame, key: str, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """Fingerprints of documents whose chunks are rows: ``key, start_word long, h1 long, h2 long``.

    Each chunk is shifted by its own start, so the sum needs no order and is combined on the map side. Chunks may be
    of any whole number of words. Null keys form one document.
    """

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            for i, (base, p) in enumerate(zip(BASES, primes), 1):
                d[f"h{i}"] = [h * pow(base % p, s, p) % p for s, h in zip(d["start_word"], d[f"h{i}"])]
            yield pa.RecordBatch.from_pydict(d, schema=batch.schema)

    rows = chunks.select(key, F.col("start_word").cast("long"), F.col("h1").cast("long"), F.col("h2").cast("long"))
    summed = rows.mapInArrow(shift, rows.schema).groupBy(key).agg(F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    return summed.select(key, *[F.pmod(F.col(f"h{i}"), F.lit(p)).alias(f"fp{i}") for i, p in enumerate(primes, 1)])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", primes: tuple[int, int] = PRIMES, huge: int = HUGE_BYTES) -> DataFrame:
    """One row per document: ``doc_id, row, n_bytes, fp1, fp2, mixed, sha256``; ``row`` tells rows of one id and text apart.

    Texts of more than ``huge`` bytes are cut into pieces of a MiB, which are dealt to all tasks, hashed there and
    combined by their places (:func:`combine_chunks`), equal ones once; others are hashed whole in the task that reads them. ``mixed`` is
    another hash of the text, by which a row is found again.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), utf8(text).alias("raw"))
    size = F.octet_length("raw").cast("long")
    rows = rows.withColumn("n_bytes", size)
    own = [F.xxhash64("raw").alias("mixed"), F.sha2("raw", 256).alias("sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(primes)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                hashes = [pa.array(h) for h in maker.texts(part.column(part.num_columns - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *hashes], [*part.schema.names[:-1], "h1", "h2"])

    small = rows.filter(F.col("n_bytes") <= huge).select("doc_id", "row", "n_bytes", *own, "raw")
    small = small.mapInArrow(run, "doc_id long, row long, n_bytes long, mixed long, sha256 string, h1 long, h2 long")
    small = small.withColumnsRenamed({"h1": "fp1", "h2": "fp2"})
    large = rows.filter(F.col("n_bytes") > huge).select("doc_id", "row", "n_bytes", *own, "raw")
    last = F.floor((F.col("n_bytes") - 1) / PIECE_BYTES).cast("int")
    pieces = large.select("sha256", "raw", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    pieces = pieces.select("sha256", (F.col("i").cast("long") * (PIECE_BYTES // 4)).alias("start_word"), F.substring("raw", F.col("i") * PIECE_BYTES + 1, F.lit(PIECE_BYTES)).alias("piece"))
    hashed = pieces.repartition("sha256", "start_word").mapInArrow(run, "sha256 string, start_word long, h1 long, h2 long").dropDuplicates(["sha256", "start_word"])
    large = large.drop("raw").join(combine_chunks(hashed, "sha256", primes), "sha256")
    return small.unionByName(large).select("doc_id", "row", "n_bytes", "fp1", "fp2", "mixed", "sha256")


CLASS = ["fp1", "fp2", "n_bytes"]


def _differing(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """``row`` of members whose bytes differ from those of their class's kept document, found by one pass over their chunks.

    ``members`` has one row per document of a class of two or more: ``doc_id, row, mixed, sha256``, CLASS, ``keep`` and
    ``size``. A class is dealt out in salted parts of about 500 members, each with its own copy of the kept document's
    chunks, so a class of a third of all rows is spread over many tasks. A task holds one chunk of the kept document at a
    time. Rows of one id and text are compared once and share the outcome.
    """
    is_kept = F.col("row") == F.col("keep.row")
    once = members.groupBy("doc_id", "mixed", "sha256", *CLASS).agg(F.min("row").alias("row"), F.max("size").alias("size"), F.max(is_kept).alias("kept"))
    once = once.select(F.col("doc_id").alias("m_id"), F.col("mixed").alias("m_mixed"), "sha256", *CLASS, "row", "size", "kept")
    raw = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("raw")).withColumn("mixed", F.xxhash64("raw"))
    rows = raw.join(once, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("mixed") == F.col("m_mixed")))
    rows = rows.filter(F.sha2("raw", 256) == F.col("sha256"))
    parts = F.ceil(F.col("size") / MEMBERS_PER_TASK_GROUP).cast("int")
    salts = F.when(F.col("kept"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("row"), parts).cast("int")))
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / CHUNK_BYTES)).cast("int")
    pieces = (
        rows.withColumn("salt", F.explode(salts))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
        .select(*CLASS, "salt", "chunk", "row", (~F.col("kept")).alias("later"), F.substring("raw", F.col("chunk") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)).alias("piece"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, b""
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            wrong = []
            for row, where, later, piece in zip(cols[5], zip(*cols[:5]), cols[6], cols[7]):
                if not later and where != at:
                    at, kept = where, piece
                elif later and piece != kept:
                    wrong.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.int64())], ["row"])

    place = [*CLASS, "salt"]
    dealt = pieces.repartition(*place).sortWithinPartitions(*place, "chunk", "later")
    wrong = dealt.mapInArrow(compare, "row long").distinct().join(once, "row").select("m_id", "m_mixed", F.col("sha256").alias("m_sha"))
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("mixed") == F.col("m_mixed")) & (F.col("sha256") == F.col("m_sha"))
    return members.join(wrong, same, "left_semi").select("row")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", primes: tuple[int, int] = PRIMES, huge: int = HUGE_BYTES) -> DataFrame:
    """Classes of byte-equal texts: ``doc_id, keep_id, group_size, kept, n_bytes, fp1, fp2, sha256``.

    The row with the largest ``doc_id`` of a class stays. Null texts count as empty texts. Rows that repeat a
    ``doc_id`` with the same text are members like any other, and only one of them is kept; null ids come last. Of rows
    that share an id, those with other texts are classes of their own, also where fingerprints collide. An empty table
    gives no rows; other columns of ``docs`` are ignored, whatever their names.
    """
    found = stored(fingerprints(docs, key, text, primes, huge).withColumn("pass", F.lit(0)), "fingerprints")
    total, turn, cls = found.count(), 0, [*CLASS, "pass"]
    while True:
        sizes = found.groupBy(cls).agg(F.max(F.struct("doc_id", "sha256", "row")).alias("keep"), F.count(F.lit(1)).alias("size")).withColumn("rows", F.col("size"))
        several = sizes.filter((F.col("size") > 1) & (F.col("pass") == turn))
        members = join_spread(found.filter(F.col("pass") == turn), several, cls, "rows", total)
        wrong = stored(_differing(docs, members, key, text), "differing")
        if wrong.isEmpty():
            break
        moved = F.when(F.col("moved"), F.lit(turn + 1)).otherwise(F.col("pass"))
        again = found.join(wrong.withColumn("moved", F.lit(True)), "row", "left").withColumn("pass", moved)
        before, found = found, stored(again.select(*found.columns), "fingerprints")
        drop_stored(before)
        drop_stored(wrong)
        turn += 1
    rows = join_spread(found, sizes, cls, "rows", total)
    kept = F.col("row") == F.col("keep.row")
    return rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), "n_bytes", "fp1", "fp2", "sha256")


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with their own columns; one of rows that repeat an id and text."""
    kept = exact_groups(docs, key, text).filter("kept")
    if docs.groupBy(key).count().filter("count > 1").isEmpty():
        kept = kept.select(F.col("doc_id").alias("__id"))
        return docs.join(kept, docs[key].cast("long").eqNullSafe(kept["__id"]), "left_semi")
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("sha256").alias("__sha"))
    one = docs.withColumn("__own", F.sha2(utf8(text), 256)).dropDuplicates([key, "__own"])
    return one.join(kept, one[key].cast("long").eqNullSafe(kept["__id"]) & (one["__own"] == kept["__sha"]), "left_semi").drop("__own")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
