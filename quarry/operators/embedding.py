"""Vectors of texts, and arithmetic on columns of vectors."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import is_blank

BATCH = 32
#: Bytes of texts that are held as Python strings at once, but for one text that is longer.
TEXT_BYTES = 4 << 20
#: Texts -> matrix of one row each.
Encoder = Callable[[list[str]], np.ndarray]


#: Words of at most so many characters are remembered by a worker, with the digits of their hash.
_SHORT, _REMEMBERED = 40, 1 << 17


@lru_cache(maxsize=_REMEMBERED)
def _first_digits(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16)


class HashEncoder:
    """Built-in encoder: words counted in buckets by the first digits of their md5, scaled to length one.

    Words are lower-case runs of other than white space. It needs no training and is the same for index and query. The
    words of all texts that it is given are coded by a dictionary, and only its entries are hashed; counting is one sum
    over codes.
    """

    #: Texts at once, where the caller can choose.
    batch_size = 1024

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [text.lower().split() for text in texts]
        coded = pa.array(itertools.chain.from_iterable(words), pa.string()).dictionary_encode()
        digits = [_first_digits(word) if len(word) <= _SHORT else _first_digits.__wrapped__(word) for word in coded.dictionary.to_pylist()]
        buckets = np.array(digits, dtype=np.int64) % self.dim
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        places = owner * self.dim + buckets[coded.indices.to_numpy()] if len(coded) else owner
        out = np.bincount(places, minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float64)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


@lru_cache(maxsize=8)
def _made(make: Callable[[], Encoder]) -> Encoder:
    return make()


def valid_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is not blank."""
    return df.filter(~is_blank(F.col(text)))


def _bounded(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about TEXT_BYTES of ``column``."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // TEXT_BYTES
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def embed_chunks(df: DataFrame, encoder: Encoder | None = None, text: str = "text", batch_size: int = BATCH, make: Callable[[], Encoder] | None = None) -> DataFrame:
    """Adds ``embedding array<double>``; null for blank texts, which never reach the encoder.

    ``make`` builds an encoder that should not be pickled, such as a model; it is called once in every worker. Texts
    are encoded ``batch_size`` at a time, or as many as an encoder asks for that has a ``batch_size`` of its own; fewer
    where they have more than TEXT_BYTES together.
    """
    base = df.drop("embedding")
    schema = T.StructType([*base.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _made(make) if make else encoder or HashEncoder()
        size = getattr(model, "batch_size", batch_size)
        for batch in _bounded(batches, text):
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            valid = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            vectors = [np.asarray(model([texts[i] for i in valid[at : at + size]]), dtype=np.float64) for at in range(0, len(valid), size)]
            lengths = np.zeros(len(texts), dtype=np.int64)
            lengths[valid] = [len(v) for part in vectors for v in part]
            missing = np.ones(len(texts) + 1, dtype=bool)
            missing[valid] = False
            missing[-1] = False
            offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            values = pa.array(np.concatenate([part.reshape(-1) for part in vectors]) if vectors else np.zeros(0), pa.float64())
            filled = pa.ListArray.from_arrays(offsets, values, mask=pa.array(missing[:-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, filled], schema.names)

    return base.mapInArrow(encode, schema)


def embedding_mismatch(chunks: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """``key, error`` of files with fewer vectors than chunks."""
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(embedding).alias("m")).filter("n <> m")
    return counts.select(key, F.format_string("Embedding count mismatch: %d chunks, %d embeddings", "n", "m").alias("error"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """``v`` scaled to length one; a zero or empty vector stays."""
    length = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))


#: Numbers that a task holds in partial sums before it passes them on.
HELD_NUMBERS = 4 << 20


def _parts(batch: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a batch of ``key, vector``; for every number that is not null, its key's code, place and value."""
    coded = batch.column(0).dictionary_encode()
    codes = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)
    keys = [*coded.dictionary.to_pylist(), *([None] if batch.column(0).null_count else [])]
    vectors = batch.column(1)
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = vectors.flatten()
    known = numbers.is_valid().to_numpy(zero_copy_only=False)
    code, ends = np.repeat(codes, lengths), np.cumsum(lengths)
    place = np.arange(len(code)) - np.repeat(ends - lengths, lengths)
    return keys, code[known], place[known], numbers.to_numpy(zero_copy_only=False)[known].astype(np.float64)


class _Sums:
    """Per place, the sum and the count of a key's numbers."""

    ddl = "sums array<double>, counts array<long>"

    def __init__(self, sums: np.ndarray, counts: np.ndarray):
        self.sums, self.counts = np.asarray(sums, dtype=np.float64), np.asarray(counts, dtype=np.int64)

    @staticmethod
    def of(batch: pa.RecordBatch) -> Iterator[tuple[object, _Sums]]:
        keys, code, place, x = _parts(batch)
        width = int(place.max()) + 1 if len(place) else 0
        sums = np.bincount(code * width + place, x, len(keys) * width).reshape(len(keys), width)
        counts = np.bincount(code * width + place, minlength=len(keys) * width).reshape(len(keys), width)
        for key, s, c in zip(keys, sums, counts):
            if c.any():
                size = int(np.flatnonzero(c)[-1]) + 1
                yield key, _Sums(s[:size], c[:size])

    def merge(self, other: _Sums) -> _Sums:
        long, short = (self, other) if len(self.sums) >= len(other.sums) else (other, self)
        sums, counts = long.sums.copy(), long.counts.copy()
        sums[: len(short.sums)] += short.sums
        counts[: len(short.sums)] += short.counts
        return _Sums(sums, counts)

    def size(self) -> int:
        return 2 * len(self.sums)

    def row(self) -> tuple:
        return self.sums.tolist(), self.counts.tolist()


class _Moments:
    """Count, mean and sum of squared deviations of all of a key's numbers; merging keeps digits where the mean is large."""

    ddl = "n double, mean double, squares double"

    def __init__(self, n: float, mean: float, squares: float):
        self.n, self.mean, self.squares = n, mean, squares

    @staticmethod
    def of(batch: pa.RecordBatch) -> Iterator[tuple[object, _Moments]]:
        keys, code, _, x = _parts(batch)
        n = np.bincount(code, minlength=len(keys)).astype(np.float64)
        mean = np.bincount(code, x, len(keys)) / np.maximum(n, 1)
        squares = np.bincount(code, (x - mean[code]) ** 2, len(keys))
        return ((k, _Moments(*m)) for k, *m in zip(keys, n.tolist(), mean.tolist(), squares.tolist()) if m[0])

    def merge(self, other: _Moments) -> _Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        return _Moments(n, self.mean + apart * other.n / n, self.squares + other.squares + apart * apart * self.n * other.n / n)

    def size(self) -> int:
        return 3

    def row(self) -> tuple:
        return self.n, self.mean, self.squares


def _partial(kind, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    size, key_type = 0, pa.null()

    def out() -> pa.RecordBatch:
        rows = list(zip(*((key, *part.row()) for key, part in held.items())))
        return pa.record_batch([pa.array(rows[0], key_type), *map(pa.array, rows[1:])], names=names)

    for batch in batches:
        key_type = batch.column(0).type
        for key, part in kind.of(batch):
            size += 0 if key in held else part.size()
            held[key] = held[key].merge(part) if key in held else part
        if size > HELD_NUMBERS:
            yield out()
            held, size = {}, 0
    if held:
        yield out()


def _whole(kind, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of rows that are sorted by key; one key is held at a time."""
    key_type = pa.null()
    rows = []
    for batch in batches:
        key_type = batch.column(0).type
        for key, *part in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[-1][0] == key:
                rows[-1] = (key, rows[-1][1].merge(kind(*part)))
                continue
            if len(rows) >= 100:
                yield _rows(rows, key_type, names)
                rows = []
            rows.append((key, kind(*part)))
    if rows:
        yield _rows(rows, key_type, names)


def _rows(found: list, key_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*((key, *part.row()) for key, part in found)))
    return pa.record_batch([pa.array(columns[0], key_type), *map(pa.array, columns[1:])], names=names)


def _by_key(df: DataFrame, key: str, embedding: str, kind) -> DataFrame:
    """``key`` and what ``kind`` makes of its vectors: a row for each key from each task, merged by key.

    So what is shuffled is keys x tasks rows at most, and a key of a third of all rows is a row from each task like any
    other.
    """
    ddl = f"`{key}` {dict(df.dtypes)[key]}, {kind.ddl}"
    own = df.filter(F.col(embedding).isNotNull()).select(key, F.col(embedding).alias("__v"))
    names = [key, *(part.split()[0] for part in kind.ddl.split(", "))]
    parts = own.mapInArrow(partial(_partial, kind, names), ddl)
    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(partial(_whole, kind, names), ddl)


def mean_pool(df: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """``key, embedding``: the mean of a key's vectors, place by place; nulls, and places that a vector lacks, are left out.

    A null key is a key. Keys without a number in any vector have no row.
    """
    sums = _by_key(df, key, embedding, _Sums)
    return sums.select(key, F.zip_with("sums", "counts", lambda s, n: F.when(n > 0, s / n)).alias("embedding"))


def embedding_dim(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row, ``dim``. Vectors of several widths are an error when the result is read."""
    agg = df.agg(F.min(F.size(embedding)).alias("a"), F.max(F.size(embedding)).alias("b"))
    return agg.select(F.when(F.col("a") == F.col("b"), F.col("a")).when(F.col("a").isNotNull(), F.raise_error(F.lit("vectors of several widths"))).alias("dim"))


def embedding_stats(df: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """``key, mean, std`` (of the population) over all numbers of a key's vectors; keys without a number have no row."""
    moments = _by_key(df, key, embedding, _Moments)
    return moments.select(key, "mean", F.sqrt(F.col("squares") / F.col("n")).alias("std"))
