"""Removal of repeated byte strings by distributed suffix sorting.

A byte goes if it lies in a string of ``length`` bytes (100) that also starts earlier in the corpus. Sorting every
suffix of a corpus moves it many times over, so the strings that could repeat are found first, without losing any:

1. *Anchors.* Of the 24-byte grams inside a 100-byte string, the one with the least hash is the string's anchor.
   Equal strings have equal anchors at equal places, so a string whose anchor's hash occurs once in the corpus cannot
   repeat. The strings of one anchor occurrence are neighbours; together they are a stretch of at most 176 bytes. One
   shuffle of two hashes (of the anchor and of its whole stretch) for each 40 bytes or so brings anchors together.
   Those that occur once are done with.
2. *Claims.* Stretches of one anchor whose hashes agree are sorted by their places, and each claims to equal the one
   before it. Claims of neighbouring stretches on the same text are one claim. The claimed bytes go to the text they
   are said to equal and are compared there. As each stretch has one claim on it at most, no text gets many.
3. *Stretches.* Where one anchor has several different stretches, the first of each kind is cut out of its text and
   meets the others by the anchor's hash. Anchors of very many different stretches meet by their whole strings
   instead, one row each, so no group grows with the corpus.
4. *Suffix sort.* Every task sorts the suffixes of its stretches by the difference-cover algorithm (sampled triples,
   recursion on names, merge of the others, :mod:`quarry.llm.suffix_sort`) in blocks of whole groups, and compares
   the prefixes of adjacent suffixes: a run of suffixes with 100 bytes in common is one string, of which the first
   occurrence stays.

Nothing is removed because hashes agree: bytes are compared before. Where a claim doesn't hold, its strings and those
they were said to equal go to the suffix sort with the stretches of their anchor, so hashes that collide cost work and
change no result.
The places found come back as spans per document and are cut out of the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import table, utf8
from quarry.llm.suffix_sort import equal_prefixes, suffix_order

LENGTH, GRAM = 100, 24
#: Anchors of more different stretches than this, or of more bytes of them, meet by whole strings.
HOT, HOT_BYTES = 8_000, 1 << 21
#: Bytes of stretches that are suffix-sorted at once, but for a group that is larger by itself.
BLOCK_BYTES = 1 << 19
#: Single strings a task remembers to settle later copies at once; when full it starts anew, which changes no result.
REMEMBERED = 100_000
GROUP_BYTES = 1 << 19
#: Bytes of one claim, at most.
CLAIM_BYTES = 1 << 18
SEED = 20240501
_SPREAD = 0x9E3779B97F4A7C15
_INDEX_BITS = 24
_SHIFT = 40


class Anchors:
    """Finds the anchor of every string of ``length`` bytes in many texts at once.

    Of the hashes of anchors and stretches ``bits`` bits are kept; with few of them nearly all collide.
    """

    def __init__(self, length: int = LENGTH, gram: int = GRAM, seed: int = SEED, bits: int = 64):
        if not 0 < gram <= length:
            raise ValueError("need 0 < gram <= length")
        self.mask = np.uint64((1 << bits) - 1)
        self.base = int.from_bytes(hashlib.blake2b(str(seed).encode(), digest_size=8).digest()) & ~7 | 5
        self.length, self.gram = length, gram
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            n = 2 * n
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(n, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def of(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every string start of ``raw`` the place of its anchor; the hashes of all grams; the running sums."""
        n = len(raw)
        self._grow(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.up[:n] * (raw.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        grams = (sums[self.gram :] - sums[: n + 1 - self.gram]) * self.down[: n + 1 - self.gram]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(29)
        index = np.uint64((1 << _INDEX_BITS) - 1)
        low = grams & ~index | np.arange(len(grams), dtype=np.uint64)
        wide, have = self.length - self.gram + 1, 1
        while 2 * have <= wide:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < wide:
            low = np.minimum(low[: len(low) - (wide - have)], low[wide - have :])
        return (low & index).astype(np.int64), grams, sums

    def runs(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each long enough text: its number and, per run of starts with one anchor, first start, anchor's hash, sign.

        The sign is a hash of the whole stretch; its last seven bits are the number of the run's last start from its
        first (of runs longer than 128 starts each part is a run of its own), the bit before them is 0.
        """
        for i, text in enumerate(texts):
            if len(text) < self.length:
                continue
            step = (1 << _INDEX_BITS) - self.length
            parts = []
            for at in range(0, len(text) - self.length + 1, step):
                place, grams, sums = self.of(np.frombuffer(text, dtype=np.uint8)[at : at + step + self.length - 1])
                change = place[1:] != place[:-1]
                if self.length - self.gram >= 128:
                    change |= np.arange(1, len(place)) % 128 == 0
                first = np.flatnonzero(np.append(True, change))
                last = np.append(first[1:], len(place)) - 1
                sign = (sums[last + self.length] - sums[first]) * self.down[first]
                sign = (sign ^ (sign >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                sign = sign & np.uint64(int(self.mask) << 8 & 2**64 - 1) | (last - first).astype(np.uint64)
                parts.append((first + at, grams[place[first]] & self.mask, sign))
            yield i, *(np.concatenate(c) for c in zip(*parts))


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k, nth, raw, rest``: the id, the number among rows that repeat it, the bytes, and the other columns as a struct.

    Null ids come before all others.
    """
    others = [F.col(c) for c in docs.columns if c not in (key, text)]
    rest = F.struct(*others) if others else F.lit(0)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), utf8(text).alias("raw"), rest.alias("rest"))
    if docs.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).isEmpty():
        return rows.select("k", F.lit(0).alias("nth"), "raw", "rest")
    nth = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("raw"), "raw")) - 1
    return rows.select("k", nth.alias("nth"), "raw", "rest")


def anchor_runs(rows: DataFrame, finder: Anchors) -> DataFrame:
    """``h, sign, k, loc`` of every stretch; ``loc`` holds the number among rows of one id, and the first start.

    Of stretches that are equal within a group of documents, byte for byte, all but the first are settled at once: they
    get the bit ``SETTLED`` in their sign and an ``h`` that spreads them over the tasks, so a line of many documents or
    many times in one stays few rows of its own anchor.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, nths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, batch.num_rows, 400):
                texts = batch.column(2).slice(at, 400).to_pylist()
                found = list(finder.runs(texts))
                if found:
                    o = np.repeat([at + i for i, *_ in found], [len(f) for _, f, _, _ in found])
                    first, h, sign = (np.concatenate(c) for c in list(zip(*found))[1:])
                    k, loc = ks[o], nths[o].astype(np.int64) << _SHIFT | first
                    order = np.lexsort((loc, k, sign, h))
                    alike = np.flatnonzero((h[order[1:]] == h[order[:-1]]) & (sign[order[1:]] == sign[order[:-1]]))
                    again, before = order[1:][alike], order[:-1][alike]
                    size = (sign[again] & np.uint64(SETTLED - 1)).astype(np.int64) + finder.length
                    pairs = zip((o[again] - at).tolist(), first[again].tolist(), (o[before] - at).tolist(), first[before].tolist(), size.tolist())
                    again = again[np.fromiter((texts[i][a : a + n] == texts[j][b : b + n] for i, a, j, b, n in pairs), bool, len(again))]
                    sign[again] = sign[again] & np.uint64(SETTLED - 1) | np.uint64(SETTLED)
                    spread = (k[again] * 1000003 + loc[again]).view(np.uint64) * np.uint64(_SPREAD)
                    h[again] = (spread ^ (spread >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
                    arrays = [h.view(np.int64), sign.view(np.int64), k, loc]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["h", "sign", "k", "loc"])

    return rows.select("k", "nth", "raw").mapInArrow(emit, "h long, sign long, k long, loc long")


CLAIMED, COMPARED, HOT_COMPARED, REPEATED = 0, 1, 2, 3
SETTLED = 128
_MET = ["k", "loc", "last", "h", "kind", "at"]


def meet_anchors(runs: DataFrame, hot: int = HOT) -> DataFrame:
    """``k, loc, last, h, kind, at``: stretches that repeat as a whole, that claim to, and that must be compared with others.

    Runs of one anchor come in the order of their places; a task keeps the signs of one anchor, ``hot`` at most. Of
    anchors with more, every stretch whose sign isn't kept is compared by its single strings. For a claim ``h`` and
    ``at`` hold the id and the place of the stretch it is said to equal.
    """
    low = (1 << _SHIFT) - 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, over = None, False
        first: dict[int, tuple[int, int]] = {}
        latest: dict[int, tuple[int, int]] = {}
        out: list[tuple[int, ...]] = []

        def close() -> None:
            if len(first) > 1 or over:
                kind = HOT_COMPARED if over else COMPARED
                out.extend((k, loc, (loc & low) + (sign & 127), now, kind, 0) for sign, (k, loc) in first.items())

        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            edge = np.append(True, h[1:] != h[:-1])
            single = edge & np.append(edge[1:], False)
            single[:1] = single[-1:] = False
            numbers = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            settled = (numbers[1] & SETTLED) > 0
            if settled.any():
                _, sign, k, loc = (c[settled] for c in numbers)
                zero = np.zeros(len(k), dtype=np.int64)
                done = [k, loc, (loc & low) + (sign & (SETTLED - 1)), zero, zero + REPEATED, zero]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in done], _MET)
            rows = np.flatnonzero(~single & ~settled)
            columns = [c[rows].tolist() for c in numbers]
            for code, sign, k, loc in zip(*columns):
                if code != now:
                    close()
                    now, over, first, latest = code, False, {}, {}
                if sign in latest:
                    out.append((k, loc, (loc & low) + (sign & 127), latest[sign][0], CLAIMED, latest[sign][1]))
                    latest[sign] = (k, loc)
                elif len(first) < hot:
                    first[sign] = latest[sign] = (k, loc)
                else:
                    over = True
                    out.append((k, loc, (loc & low) + (sign & 127), now, HOT_COMPARED, 0))
            if out:
                yield _columns(out, _MET)
                out = []
        close()
        if out:
            yield _columns(out, _MET)

    met = runs.repartition("h").sortWithinPartitions("h", "k", "loc")
    return met.mapInArrow(meet, ", ".join(f"{c} long" for c in _MET))


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


_STRETCH = "h long, k long, loc long, last long, stretch binary"


def _with_places(rows: DataFrame, met: DataFrame) -> DataFrame:
    """``k, nth, raw``, lists ``s, last, h, kind, at`` of the document's stretches in ``met``, and ``rest``."""
    low = F.lit((1 << _SHIFT) - 1)
    found = met.select("k", F.shiftright("loc", _SHIFT).cast("int").alias("nth"), F.struct(F.col("loc").bitwiseAND(low).alias("s"), "last", "h", "kind", "at").alias("x"))
    per_doc = found.groupBy("k", "nth").agg(F.collect_list("x").alias("xs"))
    # ``rest`` goes along unused: so the texts are shuffled in the same form as for the cut, and that shuffle is reused.
    return rows.join(per_doc, ["k", "nth"]).select("k", "nth", "raw", *[F.col(f"xs.{c}").alias(c) for c in ("s", "last", "h", "kind", "at")], "rest")


def _claims(places: DataFrame, length: int) -> DataFrame:
    """``k0, nth0, at, k, loc, last, bytes``: claims that ``bytes``, the starts ``loc..last``, are in that text at ``at``.

    Neighbouring claims on one text are one, as far as ``CLAIM_BYTES`` go.
    """
    low, names = (1 << _SHIFT) - 1, ["k0", "nth0", "at", "k", "loc", "last", "bytes"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part_at in range(0, batch.num_rows, 200):
                out: list[tuple] = []
                for k, nth, text, *lists in zip(*(c.slice(part_at, 200).to_pylist() for c in batch.columns[:8])):
                    merged: list[list[int]] = []
                    for k0, nth0, shift, s, last in sorted((h, at >> _SHIFT, (at & low) - s, s, last) for s, last, h, kind, at in zip(*lists) if kind == CLAIMED):
                        new = merged[-1] if merged else None
                        if new and new[:3] == [k0, nth0, shift] and s <= new[4] + length and last - new[3] < CLAIM_BYTES:
                            new[4] = max(new[4], last)
                        else:
                            merged.append([k0, nth0, shift, s, last])
                    out.extend((k0, nth0, s + shift, k, nth << _SHIFT | s, last, text[s : last + length]) for k0, nth0, shift, s, last in merged)
                if out:
                    *numbers, texts = zip(*out)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(texts, pa.binary())], names)

    return places.mapInArrow(emit, "k0 long, nth0 long, at long, k long, loc long, last long, bytes binary")


def _judged(rows: DataFrame, claims: DataFrame, finder: Anchors) -> tuple[DataFrame, DataFrame]:
    """``k, loc, last`` of the claims that hold, each compared with the text it is on, and stretches of those that don't.

    The stretches, in the form of :func:`_stretches`, have the strings that differ and those they were said to equal,
    each by its anchor, where the stretches of the other hashes are, and by itself, as those of hot anchors are. So a
    string meets all others even if it only looked like one that was left out.
    """
    texts = rows.select(F.col("k").alias("k0"), F.col("nth").alias("nth0"), "raw", "rest")
    said = F.substr("raw", (F.col("at") + 1).cast("int"), F.length("bytes"))
    joined = claims.withColumn("nth0", F.col("nth0").cast("int")).join(texts, ["k0", "nth0"])
    # All columns are named on both ways, so that the shuffles of texts and claims have the form in which they are reused.
    holds = F.when(said == F.col("bytes"), F.lit(True)).otherwise(F.to_json(F.struct("rest")).isNull())
    failing = joined.filter(said != F.col("bytes")).select("k0", "nth0", "at", "k", "loc", "last", "bytes", said.alias("said"), "rest")
    return joined.filter(holds).select("k", "loc", "last"), failing.mapInArrow(lambda batches: _differing(batches, finder), _STRETCH)


def _differing(batches: Iterator[pa.RecordBatch], finder: Anchors) -> Iterator[pa.RecordBatch]:
    length = finder.length
    for batch in batches:
        for k0, nth0, at, k, loc, last, mine, said in zip(*(c.to_pylist() for c in batch.columns[:8])):
            off = np.flatnonzero(np.frombuffer(mine, np.uint8) != np.frombuffer(said, np.uint8))
            start = loc & (1 << _SHIFT) - 1
            n = last - start + 1
            differ = union(np.maximum(off - length + 1, 0).tolist(), np.minimum(off + 1, n).tolist())
            out: list[tuple] = []
            ends = [0, *(x for pair in differ for x in pair), n]
            for a, b in zip(ends[::2], ends[1::2]):
                if a < b:
                    out.append((hash((k, loc + a)), k, loc + a, start + b - 1, None))
            for a, b in differ:
                for doc, place, text in ((k, loc, mine), (k0, nth0 << _SHIFT | at, said)):
                    part, begin = text[a : b - 1 + length], (place & (1 << _SHIFT) - 1) + a
                    base = place >> _SHIFT << _SHIFT
                    for _, first, h, sign in finder.runs([part]):
                        for s, code, size in zip(first.tolist(), h.view(np.int64).tolist(), (sign & np.uint64(SETTLED - 1)).tolist()):
                            out.append((code, doc, base | begin + s, begin + s + size, part[s : s + size + length]))
                    for j in range(len(part) - length + 1):
                        one = part[j : j + length]
                        out.append((_code(one), doc, base | begin + j, begin + j, one))
            yield _batch(out)


def _code(one: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(one, digest_size=8).digest(), "big", signed=True)


def _stretches(places: DataFrame, length: int) -> DataFrame:
    """``h, k, loc, last, stretch``: stretches to be compared by ``h``, and settled ones, without ``stretch``.

    ``loc`` holds the document's number and the first string start, ``last`` is the last string start.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out: list[tuple] = []
                for k, nth, text, *lists in zip(*(c.slice(at, 200).to_pylist() for c in batch.columns[:7])):
                    if not any(lists[3]):
                        continue
                    base, settled = nth << _SHIFT, []
                    for s, last, h, kind in zip(*lists):
                        if kind == REPEATED:
                            settled.append((s, last))
                        elif kind == COMPARED:
                            out.append((h, k, base | s, last, text[s : last + length]))
                        elif kind == HOT_COMPARED:
                            for j in range(s, last + 1):
                                one = text[j : j + length]
                                earlier = seen.get(one)
                                if earlier is not None and earlier < (k, base | j):
                                    settled.append((j, j))
                                    continue
                                if len(seen) >= REMEMBERED:
                                    seen.clear()
                                seen[one] = (k, base | j)
                                out.append((_code(one), k, base | j, j, one))
                    for a, b in union([a for a, _ in settled], [b + 1 for _, b in settled]):
                        out.append((hash((k, a)), k, base | a, b - 1, None))
                if out:
                    yield _batch(out)

    return places.mapInArrow(emit, _STRETCH)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    *numbers, stretch = zip(*rows)
    arrays = [*(pa.array(c, pa.int64()) for c in numbers), pa.array(stretch, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["h", "k", "loc", "last", "stretch"])


def later_strings(stretches: list[tuple[tuple[int, int], bytes]], length: int) -> list[tuple[int, int, int]]:
    """``index, first, last`` of runs of string starts in ``stretches`` that also start in an earlier one.

    ``stretches`` are distinct texts with their places; places give the order, and texts that overlap share places. The
    suffixes of all of them are sorted together; suffixes that share their first ``length`` bytes stand side by side.
    """
    order = sorted(range(len(stretches)), key=lambda i: stretches[i][0])
    text = np.frombuffer(b"".join(stretches[i][1] for i in order) + bytes(8), dtype=np.uint8)
    sizes = np.array([len(stretches[i][1]) for i in order])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(order)), sizes)
    inside = np.arange(len(owner)) - begins[owner]
    whole = inside <= sizes[owner] - length
    ranked = suffix_order(text[:-8])
    ranked = ranked[whole[ranked]]
    same = equal_prefixes(text, ranked, length)
    cls = np.cumsum(~same) - 1
    low = (1 << _SHIFT) - 1
    docs = {doc: i for i, doc in enumerate(sorted({(k, loc >> _SHIFT) for (k, loc), _ in stretches}))}
    starts = np.array([docs[k, loc >> _SHIFT] << _SHIFT | loc & low for k, loc in (stretches[i][0] for i in order)])
    place = (starts[owner] + inside)[ranked]
    earliest = np.full(int(cls[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, cls, place)
    gone = np.sort(ranked[place != earliest[cls]])
    if not len(gone):
        return []
    cut = np.flatnonzero(np.append(True, (gone[1:] != gone[:-1] + 1) | (owner[gone[1:]] != owner[gone[:-1]])))
    ends = np.append(cut[1:], len(gone)) - 1
    who = owner[gone[cut]]
    return list(zip((order[i] for i in who.tolist()), inside[gone[cut]].tolist(), inside[gone[ends]].tolist()))


def _settle(stretches: DataFrame, length: int) -> DataFrame:
    """``k, loc, last``: runs of starts ``loc..last`` of strings that start earlier too."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[tuple[int, int], bytes]] = []
        group: dict[bytes, tuple[int, int]] = {}
        out: list[tuple[int, int, int]] = []
        size, now, low = 0, None, (1 << _SHIFT) - 1

        def flush() -> None:
            nonlocal size
            for i, a, b in later_strings(block, length) if block else ():
                k, loc = block[i][0]
                out.append((k, loc + a, (loc & low) + b))
            block.clear()
            size = 0

        def close() -> None:
            nonlocal size
            if len(group) > 1:
                more = sum(map(len, group))
                if size + more > BLOCK_BYTES:
                    flush()
                block.extend((place, s) for s, place in group.items())
                size += more

        for batch in batches:
            for h, k, loc, last, stretch in zip(*(c.to_pylist() for c in batch.columns)):
                if stretch is None:
                    out.append((k, loc, last))
                    continue
                if h != now:
                    close()
                    now, group = h, {}
                if group.setdefault(stretch, (k, loc)) != (k, loc):
                    out.append((k, loc, last))
            if out:
                yield _columns(out, ["k", "loc", "last"])
                out = []
        close()
        flush()
        if out:
            yield _columns(out, ["k", "loc", "last"])

    met = stretches.repartition("h").sortWithinPartitions("h", "k", "loc")
    return met.mapInArrow(compare, "k long, loc long, last long")


def _with_spans(docs: DataFrame, key: str, text: str, length: int, gram: int, hot: int, seed: int, bits: int) -> DataFrame:
    """``k, nth, raw``, lists ``s, e`` of the spans that go (null without any), and ``rest``."""
    rows = keyed(docs, key, text)
    finder = Anchors(length, gram, seed, bits)
    places = _with_places(rows, meet_anchors(anchor_runs(rows, finder), min(hot, max(1, HOT_BYTES // (2 * length)))))
    held, differing = _judged(rows, _claims(places, length), finder)
    found = _settle(_stretches(places, length).unionByName(differing), length).unionByName(held)
    low = F.lit((1 << _SHIFT) - 1)
    spans = found.select(
        "k", F.shiftright("loc", _SHIFT).cast("int").alias("nth"), F.struct(F.col("loc").bitwiseAND(low).alias("s"), (F.col("last") + length).alias("e")).alias("p")
    )
    per_doc = spans.groupBy("k", "nth").agg(F.collect_list("p").alias("ps"))
    return rows.join(per_doc, ["k", "nth"], "left").select("k", "nth", "raw", F.col("ps.s").alias("s"), F.col("ps.e").alias("e"), "rest")


def _kept(raw: bytes, s: list[int] | None, e: list[int] | None) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal spans that go, and the bytes that stay."""
    merged = union(s, e) if s else []
    stops = [0, *(x for pair in merged for x in pair), len(raw)]
    return merged, b"".join(raw[a:b] for a, b in zip(stops[::2], stops[1::2]))


def repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, seed: int = SEED, bits: int = 64
) -> DataFrame:
    """``doc_id, nth, raw, spans, kept, rest`` of every row: its bytes, the maximal spans that go, and the bytes that stay.

    ``rest`` is a struct of the other columns of ``docs`` (0 without any).

    ``spans`` is an array of ``start, end`` in bytes. A string counts as earlier in a smaller ``doc_id``, or in the same
    document at an earlier start; among rows that repeat an id the order is that of a hash of their bytes. Null texts are
    empty, null ids come first, texts shorter than ``length`` keep all. Matches never cross documents. A text is held
    whole by the tasks that read and cut it, however long.
    """
    joined = _with_spans(docs, key, text, length, gram, hot, seed, bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raws, starts, ends = (part.column(i).to_pylist() for i in (2, 3, 4))
                spans, kept = [], []
                for raw, s, e in zip(raws, starts, ends):
                    merged, stays = _kept(raw, s, e)
                    spans.append([{"start": a, "end": b} for a, b in merged])
                    kept.append(stays)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(spans, kind), pa.array(kept, pa.binary()), part.column(5)], ["k", "nth", "raw", "spans", "kept", "rest"]
                )

    schema = T.StructType.fromDDL("k long, nth int, raw binary, spans array<struct<start:long,end:long>>, kept binary").add(joined.schema["rest"])
    out = joined.mapInArrow(cut, schema)
    return out.select(F.nullif("k", F.lit(-(1 << 63))).alias("doc_id"), "nth", "raw", "spans", "kept", "rest")


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with its own columns, the repeats cut out of its texts; ``n_chars`` follows where there is such a column.

    Every row stays, with an empty text if nothing of it is left. A character of which only a part would stay goes whole.
    """
    joined = _with_spans(docs, key, text, length, GRAM, HOT, SEED, 64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [_kept(*x)[1].decode("utf-8", "ignore") for x in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), part.column(5)], ["k", "text", "rest"])

    schema = T.StructType.fromDDL("k long, text string").add(joined.schema["rest"])
    got = joined.mapInArrow(cut, schema).withColumn("k", F.nullif("k", F.lit(-(1 << 63))))
    names = {key: F.col("k").cast(docs.schema[key].dataType), text: F.col("text")}
    cols = [names.get(c, F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("rest")[c]).alias(c) for c in docs.columns]
    return got.select(*cols)


def union(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Disjoint spans with gaps between them that cover what the given spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    size = lambda c: F.length(c).cast("long")
    return found.select(
        "doc_id",
        size("raw").alias("n_bytes"),
        (size("raw") - size("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
