"""Packing token sequences by power-of-two decomposition.

Every document is tokenized, closed with an end id and cut into full sequences and then into pieces of binary
length: the rest below the sequence length is split by the ones of its binary notation, longest first. A piece is a
sequence of its own, so no sequence crosses documents and none is padded. Sequences are sorted by length, so equal
lengths make a bucket from which batches are drawn, and numbered in that order.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop_stored, numbered, stored, table, utf8

#: Words whose ids a Python worker remembers; beyond that it starts anew, which costs time and changes nothing.
REMEMBERED = 400_000
#: White space on which the tokenizer and this module might differ, and contractions: such texts go to it whole.
_ODD_SPACE = b"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_CONTRACTION = re.compile("'[a-z]")


def _unusual(low: str, raw: bytes) -> bool:
    return bool("<|" in low or ("'" in low and _CONTRACTION.search(low)) or len(raw.translate(None, _ODD_SPACE)) < len(raw))


def _classes() -> np.ndarray:
    """For each Latin-1 character: 0 white space, 1 letter, 2 number (each its own word), 3 other."""
    out = np.full(256, 3, dtype=np.uint8)
    for c in map(chr, range(256)):
        kind = unicodedata.category(c)[0]
        out[ord(c)] = 0 if c in " \t\n\r" else 1 if kind == "L" else 2 if kind == "N" else 3
    return out


def _byte_letters() -> list[str]:
    """The byte-level alphabet of such vocabularies: printable bytes stand for themselves, others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordTokenizer:
    """Ids of many texts by a lower-casing word tokenizer, each distinct word being tokenized once.

    Words are found over the bytes of a whole batch at once, looked up by their 16 bytes and their length (longer ones by
    number), and only new ones go to the tokenizer's model. Texts beyond Latin-1, and the unusual ones, go to the tokenizer as they are.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.model, self.letters, self.classes = self.tokenizer.model, _byte_letters(), _classes()
        self.masks = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.long: dict[bytes, int] = {}
        self.keys = np.zeros((3, 1024), dtype=np.uint64)
        self.spans = np.zeros((2, 1024), dtype=np.int64)
        self.flat, self.used = np.zeros(8192, dtype="<u4"), 0

    def _add(self, code: int, k1: int, k2: int, k3: int, word: bytes) -> int:
        mapped = "".join(self.letters[b] for b in word.decode("latin-1").encode())
        ids = [t.id for t in self.model.tokenize(mapped)]
        n = len(self.known)
        if n == self.keys.shape[1]:
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)], axis=1)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.keys[:, n], self.spans[:, n] = (k1, k2, k3), (self.used, len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known[code] = n
        return n

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, at = [], []
        for i, t in enumerate(texts):
            low = t.lower()
            try:
                raw = low.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            if raw is None or _unusual(low, raw):
                out[i] = self._whole(t)
            else:
                plain.append(raw)
                at.append(i)
        for i, ids in zip(at, self._plain(plain) or [self._whole(texts[i]) for i in at]):
            out[i] = ids
        return out

    def _plain(self, raws: list[bytes]) -> list[np.ndarray] | None:
        """Ids of lower-case Latin-1 texts; None if two words clash in the table."""
        joined = b"\n".join(raws) + b"\n" + bytes(24)
        chars = np.frombuffer(joined, dtype=np.uint8)
        kind = self.classes[chars]
        kind[-24:] = 0
        before = np.concatenate([np.zeros(1, dtype=np.uint8), kind[:-1]])
        edges = np.flatnonzero((kind != before) | (kind == 2))
        spaces = kind[edges] == 0
        first = ~spaces
        starts, ends = edges[first], np.append(edges[1:], len(chars))[first]
        if not len(starts):
            return [np.zeros(0, dtype="<u4")] * len(raws)
        lengths = ends - starts
        eights = np.lib.stride_tricks.as_strided(chars, (len(chars) - 7, 8), (1, 1))
        tail = np.minimum(starts + 8, len(chars) - 8)
        k1 = eights[starts].view("<u8")[:, 0] & self.masks[np.minimum(lengths, 8)]
        k2 = eights[tail].view("<u8")[:, 0] & self.masks[np.clip(lengths - 8, 0, 8)]
        for i in np.flatnonzero(lengths > 16).tolist():
            word = joined[starts[i] : ends[i]]
            k1[i], k2[i] = self.long.setdefault(word, len(self.long)), 2**64 - 1
        k3 = np.minimum(lengths, 17).astype(np.uint64)
        codes = k1 * np.uint64(0x9E3779B97F4A7C15) ^ (k2 + k3 * np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        codes ^= codes >> np.uint64(29)
        order = np.argsort(codes)
        ranked = codes[order]
        fresh = np.append(True, ranked[1:] != ranked[:-1])
        distinct, one = ranked[fresh], order[fresh]
        back = np.empty(len(codes), dtype=np.int64)
        back[order] = np.cumsum(fresh) - 1
        if len(self.known) + len(distinct) > self.remembered and self.known:
            self._forget()
            return self._plain(raws)
        get = self.known.get
        found = [get(c, -1) for c in distinct.tolist()]
        for j, n in enumerate(found):
            if n < 0:
                i = one[j]
                found[j] = self._add(int(distinct[j]), int(k1[i]), int(k2[i]), int(k3[i]), joined[starts[i] : ends[i]])
        index = np.array(found)[back]
        if any((own[index] != k).any() for own, k in zip(self.keys, (k1, k2, k3))):
            return None
        begin, count = self.spans[0][index], self.spans[1][index]
        upto = np.cumsum(count)
        ids = self.flat[np.repeat(begin - (upto - count), count) + np.arange(upto[-1])]
        stops = np.cumsum([len(r) + 1 for r in raws])
        cut = np.append(0, upto)[np.searchsorted(starts, stops)]
        return np.split(ids, cut[:-1])


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@lru_cache(maxsize=8192)
def cuts(rest: int) -> tuple[int, ...]:
    """Binary lengths that sum to ``rest``, longest first."""
    return tuple(1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1)


def decompose(n: int, longest: int) -> list[int]:
    return [longest] * (n // longest) + list(cuts(n % longest))


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, max_tokens: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``ids``.

    ``ids`` is left out where only the digest is needed. ``max_tokens`` must be a power of two. Null and empty texts
    are documents of the end id alone. Rows that repeat an id are packed each on its own. ``sequence_id`` numbers the
    pieces by length (longest first), document and start, so a bucket is a range of it and it doesn't depend on the
    partitions of ``docs``; ``offset`` is always 0. An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                keys = part.column(0).to_pylist()
                texts = [t.decode("utf-8", "replace") for t in part.column(1).to_pylist()]
                rows: list[list] = [[], [], [], [], []]
                ids: list[np.ndarray] = []
                for k, found in zip(keys, words.batch(texts)):
                    raw = found.tobytes() + end
                    n, start = len(raw) // 4, 0
                    for length in decompose(n, max_tokens):
                        piece = raw[4 * start : 4 * (start + length)]
                        for column, value in zip(rows, (k, start, length, zlib.crc32(piece), n)):
                            column.append(value)
                        if with_ids:
                            ids.append(np.frombuffer(piece, dtype="<i4"))
                        start += length
                arrays = [pa.array(c, pa.int64()) for c in rows]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("raw")).mapInArrow(run, schema)
    pieces = stored(rows.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    # Only what tells pieces apart is sorted: with their ids, the longest would make the first of its parts far the largest.
    order = pieces.drop("ids").withColumn("shorter", -F.col("length"))
    bucketed = numbered(order, ["shorter", "doc_id", "start", "doc_tokens", "ids_crc32"], "sequence_id", "buckets").drop("shorter")
    if with_ids:
        bucketed = bucketed.join(pieces.select("piece", "ids"), "piece")
    else:
        drop_stored(pieces)
    return bucketed.drop("piece").withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces as one folder per length, so that a reader draws equal lengths without padding.

    Pieces are dealt out by ranges of ``sequence_id``, so a task writes to a few folders only. An empty table makes an
    empty folder.
    """
    pieces.withColumn("bucket", F.col("length")).repartitionByRange("sequence_id").write.partitionBy("bucket").parquet(path)


def production_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), production_path(), end_id=2, with_ids=False)
