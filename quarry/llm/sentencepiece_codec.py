"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

The vocabulary's merges are applied by an agenda: all neighbouring pairs that make a piece wait in order of score; the
best is merged and its new neighbours join the agenda. With dropout, a pair taken from the agenda is skipped if a
keyed hash of the seed, the document, its place in it and its piece falls below the rate, so other merges win and each
occurrence of a word is varied on its own, alike for the same seed. Every segmentation decodes to the text.

No piece joins a sign to a space mark behind it, nor a letter to a stop or comma, so text is segmented unit by unit
(space marks and what follows them); a model with pieces that do join such signs has its texts segmented whole. A unit's merges without dropout are remembered with its ids: an occurrence whose
hashes skip none of these has these ids, and only the others are segmented anew.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, utf8

DROPOUT, SEED = 0.1, 20240501
#: Units a worker remembers; when full it starts anew.
REMEMBERED = 300_000
#: Occurrences of units that are worked off together.
TOGETHER = 1 << 17
MARK = "▁"
_UNITS = re.compile(f"{MARK}*+[A-Za-zÀ-ÖØ-öø-ɏ]++(?=[.,!?;:])|{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Stands for a space mark that is part of the text itself; such signs are written as bytes.
_OWN_MARK = ""
#: Stands for the sign above where a text has it.
_OWN_STAND_IN = "\ud800"
_MASK = (1 << 64) - 1
_BY_RANK, _BY_START, _BY_HASH = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9
_NEVER = (1 << 31) - 1
#: Units of more characters than this are merged by a heap.
_LONG = 48


#: A piece with such a place in it would join two units.
_JOINS_UNITS = re.compile(f"[^{MARK}]{MARK}|\n.|.\n|[A-Za-zÀ-ÖØ-öø-ɏ][.,!?;:]", re.DOTALL)


def _split(text: str, whole: bool = False) -> list[str]:
    if _OWN_MARK not in text:
        text = text.replace(MARK, _OWN_MARK).replace(" ", MARK)
        return [text] if whole else _UNITS.findall(text)
    parts = re.split(f"({_OWN_MARK})", text)
    return [u for p in parts if p for u in ([_OWN_STAND_IN] if p == _OWN_MARK else _split(p, whole))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(_BY_HASH)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Pieces:
    """The pieces of a model file: ids and ranks of text pieces, ids of single bytes, and what each id decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, int] = {}
        self.bytes_id = [0] * 256
        self.decoded: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_id[value] = i
                self.decoded.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.decoded.append(b"")
            else:
                self.ids[piece] = i
                self.rank[piece] = int(-model.get_score(i))
                self.decoded.append(piece.replace(MARK, " ").encode())
        pairs = []
        for piece, rank in self.rank.items():
            for k in range(1, len(piece)):
                if piece[:k] in self.ids and piece[k:] in self.ids:
                    pairs.append((self.ids[piece[:k]] << 20 | self.ids[piece[k:]], rank, self.ids[piece]))
        table = np.array(pairs or [(-1, 0, 0)], dtype=np.int64)
        self.bits = max(4, 2 + len(table).bit_length())
        self.slots = np.full((1 << self.bits) + len(table), -1, dtype=np.int64)
        self.pair_rank, self.pair_id = (np.full(len(self.slots), x, dtype=np.int32) for x in (_NEVER, -1))
        waiting, slot = np.arange(len(table)), self._slot(table[:, 0])
        while len(waiting):
            placed = np.unique(slot[waiting], return_index=True)[1]
            placed = waiting[placed[self.slots[slot[waiting[placed]]] < 0]]
            for column, x in zip((self.slots, self.pair_rank, self.pair_id), table[placed].T):
                column[slot[placed]] = x
            waiting = np.setdiff1d(waiting, placed)
            slot[waiting] += 1
        self.texts = pa.array(self.decoded, pa.binary())
        self.join_units = any(map(_JOINS_UNITS.search, self.ids))
        self.of_code = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_code[ord(piece)] = i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(_BY_RANK)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and ids of the pieces that neighbouring pieces make; ``_NEVER`` where they make none.

        A pair is at its hash's place of the table or right behind it, before the next free place.
        """
        keys = left.astype(np.int64) << 20 | right
        at = self._slot(keys)
        found = self.slots[at]
        on = np.flatnonzero((found != keys) & (found >= 0))
        while len(on):
            at[on] += 1
            found = self.slots[at[on]]
            on = on[(found != keys[on]) & (found >= 0)]
        none = keys < 0
        if none.any():
            at[none] = len(self.slots) - 1
        return self.pair_rank[at], self.pair_id[at]


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


class Codec:
    """Encodes and decodes whole texts (as UTF-8 bytes; bytes that aren't UTF-8 are kept by byte pieces)."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED, remembered: int = REMEMBERED):
        if not 0 <= dropout < 1:
            raise ValueError("dropout must be at least 0 and below 1")
        self.pieces, self.limit = _pieces(path), int(dropout * (1 << 32))
        self.seed, self.remembered = seed, remembered
        self._forget()

    def _forget(self) -> None:
        """No units; then for each one where its ids and its merges begin, and those of all one behind another."""
        self.known: dict[str, int] = {}
        self.id_begins, self.merge_begins = _Grown(np.int64, [0]), _Grown(np.int64, [0])
        self.ids, self.merges = _Grown(np.uint32), _Grown(np.uint64)

    def _skipped(self, rank: int, start: int, key: int) -> bool:
        x = rank * _BY_RANK + start * _BY_START + key & _MASK
        return ((x ^ x >> 32) * _BY_HASH & _MASK) >> 32 < self.limit

    def segment(self, unit: str, key: int | None = None, merges: list[int] | None = None) -> list[int]:
        """Ids of one unit, with dropout by ``key`` or none; ``merges`` receives what the hashes of its merges start from.

        The agenda of a short unit is a list of its pairs' ranks, of which the smallest is taken (the leftmost of
        equal ones); that of a long one is a heap. Both give the same ids.
        """
        symbols = list(unit)
        if len(symbols) > _LONG:
            symbols = self._merged_by_heap(symbols, key, merges)
        elif len(symbols) > 1:
            rank, never = self.pieces.rank.get, _NEVER
            starts = list(range(len(symbols)))
            ranks = [rank(a + b, never) for a, b in zip(symbols, symbols[1:])]
            while ranks:
                best = min(ranks)
                if best == never:
                    break
                i = ranks.index(best)
                if key is not None and self._skipped(best, starts[i], key):
                    ranks[i] = never
                    continue
                if merges is not None:
                    merges.append(best * _BY_RANK + starts[i] * _BY_START & _MASK)
                pair = symbols[i] + symbols[i + 1]
                symbols[i] = pair
                del symbols[i + 1], starts[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = rank(pair + symbols[i + 1], never)
                if i:
                    ranks[i - 1] = rank(symbols[i - 1] + pair, never)
        ids, out = self.pieces.ids, []
        for s in symbols:
            if s in ids:
                out.append(ids[s])
            else:
                raw = MARK.encode() if s == _OWN_MARK else _OWN_MARK.encode() if s == _OWN_STAND_IN else s.encode("utf-8", "surrogateescape")
                out.extend(self.pieces.bytes_id[b] for b in raw)
        return out

    def _merged_by_heap(self, symbols: list[str], key: int | None, merges: list[int] | None) -> list[str]:
        rank, n = self.pieces.rank, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank]
        heapq.heapify(agenda)
        while agenda:
            best, i, pair = heapq.heappop(agenda)
            j = after[i] if symbols[i] else n
            if j >= n or symbols[i] + symbols[j] != pair or (key is not None and self._skipped(best, i, key)):
                continue
            if merges is not None:
                merges.append(best * _BY_RANK + i * _BY_START & _MASK)
            symbols[i], symbols[j] = pair, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                new = pair + symbols[after[i]]
                if new in rank:
                    heapq.heappush(agenda, (rank[new], i, new))
            if before[i] >= 0:
                new = symbols[before[i]] + pair
                if new in rank:
                    heapq.heappush(agenda, (rank[new], before[i], new))
        return [s for s in symbols if s]

    def segment_all(self, units: list[str], keys: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Ids of units one behind another and their numbers; without ``keys`` there is no dropout, and what the hashes of the merges start from follows, and their numbers.

        Units of one length class are segmented together, a merge of each at a time.
        """
        own = np.ones(len(units), dtype=bool)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        found = self.pieces.of_code[codes]
        begins = np.cumsum(sizes) - sizes
        got, traces = [], []
        for low, width in ((1, 4), (4, 6), (6, 8), (8, 11), (11, 16), (16, 32)):
            members = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(members), 4096):
                part = members[at : at + 4096]
                columns = np.arange(width + 1)
                inside = columns < sizes[part, None]
                symbols = np.where(inside, found[np.minimum(begins[part, None] + columns, len(found) - 1)], np.int32(-1))
                whole = ((symbols >= 0) == inside).all(axis=1)
                part, symbols = part[whole], symbols[whole]
                own[part] = False
                ids, counts, trace = self._merged_together(symbols, None if keys is None else keys[part])
                got.append((part, ids.astype(np.uint32), counts))
                traces.extend((part[rows], starts) for rows, starts in trace)
        for i in np.flatnonzero(own).tolist():
            merges: list[int] | None = [] if keys is None else None
            ids = self.segment(units[i], None if keys is None else int(keys[i]), merges)
            got.append((np.array([i]), np.array(ids, dtype=np.uint32), np.array([len(ids)])))
            if merges:
                traces.append((np.full(len(merges), i), np.array(merges, dtype=np.uint64)))
        ids, counts = _in_order(len(units), [(np.repeat(part, n), x) for part, x, n in got], np.uint32)
        return (ids, counts, *(_in_order(len(units), traces, np.uint64) if keys is None else ()))

    def learn(self, units: list[str]) -> None:
        """Remember the ids and merges of new units."""
        if not units:
            return
        ids, n_ids, merges, n_merges = self.segment_all(units)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units))))
        self.id_begins.add(len(self.ids) + np.cumsum(n_ids))
        self.merge_begins.add(len(self.merges) + np.cumsum(n_merges))
        self.ids.add(ids)
        self.merges.add(merges)

    def _merged_together(self, symbols: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list]:
        """The ids that are left of each row (one behind another) and their numbers; the last column is empty.

        Without ``keys`` also the rows that were merged in each round, and what the hashes of these merges start from.
        """
        n, width = symbols.shape
        cells = np.arange(n * width, dtype=np.int32)
        after, before = cells + 1, cells - 1
        before[::width] = -1
        ranks, made = (np.full((n, width), x, dtype=np.int32) for x in (_NEVER, -1))
        found = self.pieces.look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
        ranks[:, :-1], made[:, :-1] = (x.reshape(n, width - 1) for x in found)
        pieces, rank, piece = symbols.ravel(), ranks.ravel(), made.ravel()
        alive, trace = np.arange(n), []
        while len(alive):
            at = ranks[alive].argmin(axis=1)
            cell = alive * width + at
            best = rank[cell]
            going = best != _NEVER
            alive, at, cell, best = alive[going], at[going], cell[going], best[going]
            x = best.astype(np.uint64) * np.uint64(_BY_RANK) + at.astype(np.uint64) * np.uint64(_BY_START)
            if keys is None:
                trace.append((alive, x))
            else:
                skipped = self._fall_below(x + keys[alive])
                rank[cell[skipped]] = _NEVER
                cell = cell[~skipped]
            right, joined = after[cell], piece[cell]
            behind = after[right]
            pieces[cell], pieces[right], rank[right] = joined, -1, _NEVER
            after[cell], before[behind] = behind, cell
            rank[cell], piece[cell] = self.pieces.look_up(joined, pieces[behind])
            front = before[cell]
            inner = front >= 0
            front = front[inner]
            rank[front], piece[front] = self.pieces.look_up(pieces[front], joined[inner])
        left = symbols >= 0
        return symbols[left], left.sum(axis=1), trace

    def _fall_below(self, x: np.ndarray) -> np.ndarray:
        return (x ^ x >> np.uint64(32)) * np.uint64(_BY_HASH) >> np.uint64(32) < np.uint64(self.limit)

    def encode_batch(self, raws: list[bytes], places: list[int]) -> list[bytes]:
        """:meth:`encode` of many texts; their units are looked up, and segmented where dropout asks for it, together."""
        split = [_split(" " + raw.decode("utf-8", "surrogateescape"), self.pieces.join_units) if raw else [] for raw in raws]
        sizes = np.array([len(u) for u in split], dtype=np.int64)
        stops = np.cumsum(sizes)
        documents = _mixed(np.array([self.seed * _BY_RANK + p & _MASK for p in places], dtype=np.uint64))
        units = [u for part in split for u in part]
        ids, counts = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(units), TOGETHER):
            part, n = units[at : at + TOGETHER], np.arange(at, min(at + TOGETHER, len(units)))
            row = np.searchsorted(stops, n, side="right")
            position = (n - (stops - sizes)[row]).astype(np.uint64)
            found = self._encoded(part, _mixed(documents[row] + position * np.uint64(_BY_START)))
            ids.append(found[0])
            counts.append(found[1])
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        whole, ends = np.concatenate(ids).astype("<u4").tobytes(), (4 * upto[stops]).tolist()
        return [whole[start:end] for start, end in zip([0, *ends], ends)]

    def _encoded(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of occurrences of units one behind another and their numbers; ``keys`` are those of the occurrences."""
        self.tidy()
        self.learn(list(set(units).difference(self.known)))
        n = np.fromiter(map(self.known.__getitem__, units), dtype=np.int64, count=len(units))
        begins, merges = self.id_begins.array, self.merge_begins.array
        begin, count, pool = begins[n], begins[n + 1] - begins[n], self.ids.array
        if self.limit:
            sizes = merges[n + 1] - merges[n]
            x = self.merges.array[_ranges(merges[n], sizes)]
            hit = np.searchsorted(np.cumsum(sizes), np.flatnonzero(self._fall_below(x + np.repeat(keys, sizes))), side="right")
            odd = hit[np.append(True, hit[1:] != hit[:-1])] if len(hit) else hit
            if len(odd):
                ids, sizes = self.segment_all([units[i] for i in odd.tolist()], keys[odd])
                begin[odd], count[odd] = len(pool) + np.cumsum(sizes) - sizes, sizes
                pool = np.concatenate([pool, ids])
        return pool[_ranges(begin, count)], count

    def encode(self, raw: bytes, place: int = 0) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes. ``place`` is the document's number, by which dropout varies."""
        return self.encode_batch([raw], [place])[0]

    def tidy(self) -> None:
        if len(self.known) > self.remembered:
            self._forget()

    def decode(self, ids: list[int]) -> bytes:
        """The text whose ids these are, without the space that encoding puts before it."""
        return self.decode_batch(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_batch(self, ids: pa.ListArray) -> list[bytes]:
        """:meth:`decode` of many lists; their pieces are taken from an Arrow array, so no id becomes a Python object."""
        stops = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
        taken = self.pieces.texts.take(ids.flatten())
        _, places, values = taken.buffers()
        upto = np.frombuffer(places, dtype=np.int32)[: len(taken) + 1] if len(taken) else np.zeros(1, dtype=np.int32)
        whole, ends = values.to_pybytes() if values else b"", upto[stops].tolist()
        return [whole[start + 1 : end] for start, end in zip([0, *ends], ends)]


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype, first=()):
        self._all, self._n = np.zeros(1024, dtype=dtype), 0
        self.add(np.array(first, dtype=dtype))

    def __len__(self) -> int:
        return self._n

    @property
    def array(self) -> np.ndarray:
        return self._all[: self._n]

    def add(self, more: np.ndarray) -> None:
        if self._n + len(more) > len(self._all):
            self._all = np.concatenate([self.array, np.zeros(self._n + 2 * len(more), dtype=self._all.dtype)])
        self._all[self._n : self._n + len(more)] = more
        self._n += len(more)


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``begin[i] .. begin[i] + count[i] - 1`` for every i, one range behind another."""
    upto = np.cumsum(count)
    return np.repeat(begin - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)


def _in_order(n: int, parts: list[tuple[np.ndarray, np.ndarray]], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``(rows, values)`` by row, those of a row in the order given, and how many each of ``n`` rows has."""
    if not parts:
        return np.zeros(0, dtype=dtype), np.zeros(n, dtype=np.int64)
    rows = np.concatenate([r for r, _ in parts])
    return np.concatenate([v for _, v in parts])[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=n)


@lru_cache(maxsize=4)
def _codec(path: str, dropout: float, seed: int) -> Codec:
    return Codec(path, dropout, seed)


def encode(docs: DataFrame, model_path: str, dropout: float = DROPOUT, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, raw, ids, ids_crc32`` of every row: the text's bytes, its ids and their checksum.

    Null texts are empty and have no ids. Rows that repeat an id are encoded each on its own, alike. Another ``seed``
    gives another segmentation; ``dropout`` 0 gives the model's own. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path, dropout, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keys = part.column(0).to_pylist()
                found = codec.encode_batch(part.column(1).to_pylist(), [int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest()) for k in keys])
                stops = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(stops), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                crc = pa.array([zlib.crc32(f) for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids, crc], ["doc_id", "raw", "ids", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("raw"))
    return rows.mapInArrow(run, "doc_id long, raw binary, ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the bytes that ``ids`` stand for; null ids are none."""
    schema = encoded.drop("decoded").schema.add("decoded", "binary")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path, 0.0, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                got = codec.decode_batch(part.column(names.index(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names)

    return encoded.drop("decoded").mapInArrow(run, schema)


def production_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = production_path()
    coded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids_crc32",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("raw")).alias("lossless"),
    )
