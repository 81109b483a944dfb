"""Phrase collocation mining: frequent phrases of each language by contiguous pattern growth, scored and thinned by Spark.

Growth is that of PrefixSpan, for neighbouring words: every place where a phrase may begin is a pointer, pointers of a
frequent prefix are its projection, and a prefix is extended to the right by the words that follow its pointers, depth
first, for as long as the projection is large enough. Here a pointer is the window of words that follows it, cut where no
frequent phrase can go on, and windows that a task has read more than once are one with a count. They are dealt out in
ranges of their words, so that each task gets the whole projections of its prefixes as stretches of a sorted table. A
prefix of very many windows reaches over several ranges: what lies at the edge of one is counted in part there, whatever
its count, and Spark adds the parts. So no prefix needs to fit in a task.

Two passes before keep windows few. The first counts words; the second counts pairs of frequent words, each apart by 24
bits of the word that follows. They leave tables of 2^26 bits, of the same size for any corpus, by which the next pass
drops what cannot be frequent: words, pairs, and triples. A table may let through too much, never too little. Words and
pairs have their counts from these passes, so a window begins only where three words may be frequent; all counts of three
words and more are made from the windows themselves. Words go by 64-bit hashes, and the first pass proves that no frequent
word shares its hash with another word of its language (or takes another seed).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import drop_stored, stored, table

MIN_COUNT, MAX_WORDS, TOP, COVER_PERCENT = 100, 5, 2000, 100
NO_LANGUAGE = "und"
#: Bytes of text that are split at once; rows that are held before they are added up; windows that are mined at once.
TEXT_BYTES, HELD_ROWS, MINED_ROWS = 4 << 20, 1_000_000, 500_000
FILTER_BITS = 26
#: Bits that tell the word behind a pair; the rest of 63 is for a count.
NEXT_BITS = 24
#: Bits of a task's own number for a word: two of them and the bits of a next word are one number of 64 bits.
CODE_BITS = (64 - NEXT_BITS) // 2
#: Places of pairs that a task holds, 8 bytes each, before it adds them up.
HELD_PAIRS = 4_000_000
SEEDS = 8
_SPACE, _STOP = 32, 10
_FOLDED = bytes(_STOP if chr(b) in ".,;:!?\n\x0b\x0c\r" else _SPACE if b in (9, 32) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts by language, put together up to about TEXT_BYTES; a stop stands between two of them."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            part = text.as_buffer().to_pybytes()
            held.setdefault(lang, []).append(part)
            size += len(part)
            if size >= TEXT_BYTES:
                yield from ((name, b"\n".join(parts)) for name, parts in held.items())
                held, size = {}, 0
    yield from ((name, b"\n".join(parts)) for name, parts in held.items())


def _words(text: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words in order, and the number of the piece that each is in."""
    signs = np.frombuffer(text.translate(_FOLDED) + b"\n", dtype=np.uint8)
    stop = signs == _STOP
    word = ~(stop | (signs == _SPACE))
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.append(0, edge)
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(signs[word]))
    return words.dictionary_encode(), np.cumsum(stop, dtype=np.int32)[starts]


def _hashes(words: pa.Array, seed: int, bits: int) -> np.ndarray:
    """64 bits for each word (fewer only in tests), never 0, which stands for no word."""
    parts = (words.slice(start, 10_000).cast(pa.binary()).to_pylist() for start in range(0, len(words), 10_000))
    found = np.fromiter((xxhash.xxh64_intdigest(w, seed) for part in parts for w in part), np.uint64, len(words))
    return np.maximum(found >> np.uint64(64 - bits), 1).view(np.int64)


def _pair_keys(lang: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two columns of 64 bits; that of a pair and a part tells a pair with its next word."""
    mixed = (left.view(np.uint64) ^ np.uint64(xxhash.xxh64_intdigest(lang))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29)) ^ right.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def _next_parts(h: np.ndarray, pair: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For the pairs that begin ``at``, the next word by NEXT_BITS of its hash, never 0, which says that no frequent one follows in the piece."""
    follows = np.append(pair, False)[at + 1]
    part = h[np.minimum(at + 2, len(h) - 1)].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - NEXT_BITS)
    return np.where(follows, np.maximum(part, 1), 0).astype(np.int64)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _filter_of(keys: DataFrame, key: str) -> np.ndarray:
    """The bits of all ``keys``, 8 MB at most, and as much on its way to the driver."""
    bit = F.shiftrightunsigned(key, 64 - FILTER_BITS)
    found = keys.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({key}, {64 - FILTER_BITS}) & 63L as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _summed(rows: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Neighbours that are equal as one, with the sum of their counts."""
    new = np.zeros(len(n), dtype=bool)
    new[:1] = True
    for r in rows:
        new[1:] |= r[1:] != r[:-1]
    first = np.flatnonzero(new)
    return [r[first] for r in rows], np.add.reduceat(n, first) if len(first) else n


def _distinct(rows: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal windows as one, with the sum of their counts."""
    order = np.lexsort(rows[::-1])
    return _summed([r[order] for r in rows], n[order])


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order and how often each is there; ``parts`` is emptied and the numbers are sorted in place, so they are held once."""
    keys = np.concatenate(parts)
    parts.clear()
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.diff(first, append=len(keys))


_WORDS_DDL = "lang string, h long, word string, n long"


def _count_words(seed: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each language and their counts; ``h`` 0 has the number of all words."""
    held: list[pa.Table] = []

    def add_up() -> None:
        sums = pa.concat_tables(held).group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")])
        held[:] = [sums.select(["lang", "word", "n_sum"]).rename_columns(["lang", "word", "n"])]

    def added() -> Iterator[pa.RecordBatch]:
        sums = held.pop()
        words = sums.column("word").combine_chunks()
        h = _hashes(words.drop_null(), seed, bits) if words.null_count == 0 else None
        if h is None:
            known = words.is_valid().to_numpy(zero_copy_only=False)
            h = np.zeros(len(words), dtype=np.int64)
            h[known] = _hashes(words.drop_null(), seed, bits)
        out = pa.table({"lang": sums.column("lang"), "h": pa.array(h), "word": sums.column("word"), "n": sums.column("n")})
        return out.to_batches(50_000)

    for lang, text in _texts(batches):
        words, _ = _words(text)
        counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)).astype(np.int64)
        found = pa.concat_arrays([words.dictionary, pa.nulls(1, pa.string())])
        held.append(pa.table({"lang": pa.array([lang] * len(found), pa.string()), "word": found, "n": np.append(counts, len(words))}))
        if sum(map(len, held)) > HELD_ROWS:
            add_up()
            if len(held[0]) > HELD_ROWS // 2:
                yield from added()
    if held:
        add_up()
        yield from added()


def _frequent(text: bytes, seed: int, bits: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, which of them each word in order is, and whether it and the next one are in one piece and may both be frequent."""
    found, piece = _words(text)
    distinct = _hashes(found.dictionary, seed, bits)
    at = found.indices.to_numpy()
    may = _passes(words, distinct)[at] if len(distinct) else np.zeros(0, dtype=bool)
    return distinct, at, (piece[1:] == piece[:-1]) & may[1:] & may[:-1]


_PAIRS_DDL = "lang string, h1 long, h2 long, n long"


def _count_pairs(seed: int, bits: int, words: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may be frequent; ``n`` has the part of the next word in its last NEXT_BITS and the count before them.

    A pair and its part are held as one number, in which words go by their numbers in ``codes``. Those are given as words
    come, and anew once all are taken and what is held has gone out.
    """
    codes: dict[int, int] = {}
    found: dict[str, list[np.ndarray]] = {}
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows(lang: str) -> Iterator[pa.RecordBatch]:
        hashes, (keys, n) = np.fromiter(codes, np.int64, len(codes)), sums.pop(lang)
        for start in range(0, len(n), 50_000):
            some = keys[start : start + 50_000].view(np.int64)
            h1, h2 = (hashes[some >> shift & (1 << CODE_BITS) - 1] for shift in (CODE_BITS + NEXT_BITS, NEXT_BITS))
            packed = n[start : start + 50_000] << NEXT_BITS | some & (1 << NEXT_BITS) - 1
            yield pa.record_batch([pa.repeat(lang, len(some)), pa.array(h1), pa.array(h2), pa.array(packed)], names=["lang", "h1", "h2", "n"])

    def added(all_of_it: bool) -> Iterator[pa.RecordBatch]:
        """Adds up what was found; sums go out where they are many, or all."""
        for lang in list(found):
            keys, n = _counted(found.pop(lang))
            if lang in sums and len(n) > HELD_ROWS:
                yield from rows(lang)
            elif lang in sums:
                (keys,), n = _distinct([np.append(sums[lang][0], keys)], np.append(sums[lang][1], n))
            sums[lang] = keys, n
        if all_of_it or sum(len(n) for _, n in sums.values()) > HELD_ROWS:
            for lang in list(sums):
                yield from rows(lang)
            codes.clear()

    size, most = 0, 1 << CODE_BITS - 1
    for lang, text in _texts(batches):
        distinct, at, pair = _frequent(text, seed, bits, words)
        h, places = distinct[at], np.flatnonzero(pair)
        for start in range(0, len(places), most):  # of so many pairs, all words have numbers
            some = places[start : start + most]
            left, right = at[some], at[some + 1]
            used = np.zeros(len(distinct), dtype=bool)
            used[left] = used[right] = True
            hashes = distinct[used].tolist()
            if len(codes) + sum(x not in codes for x in hashes) > 1 << CODE_BITS:
                yield from added(True)
                size = 0
            own = np.zeros(len(distinct), dtype=np.uint64)
            own[used] = [codes.setdefault(x, len(codes)) for x in hashes]
            keys = own[left] << np.uint64(CODE_BITS + NEXT_BITS) | own[right] << np.uint64(NEXT_BITS) | _next_parts(h, pair, some).view(np.uint64)
            found.setdefault(lang, []).append(keys)
            size += len(keys)
            if size > HELD_PAIRS:
                yield from added(False)
                size = 0
    yield from added(True)


def _filter_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys by which frequent pairs, and those with a next word (``part`` over 0), are found in a table of bits."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy()
        h1, h2, part = (batch.column(c).to_numpy() for c in ("h1", "h2", "part"))
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            own = codes == code
            keys = _pair_keys(lang, h1[own], h2[own])
            yield pa.record_batch({"key": np.where(part[own] > 0, _pair_keys(lang, keys, part[own]), keys).view(np.int64)})


def _columns(max_words: int) -> list[str]:
    return [f"w{i}" for i in range(1, max_words + 1)]


def _find_windows(
    seed: int, bits: int, words: np.ndarray, pairs: np.ndarray, nexts: np.ndarray, max_words: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Windows of three words and more in which every two and three neighbours may be frequent; words after its end are 0."""
    held: dict[str, list[tuple[list[np.ndarray], np.ndarray]]] = {}

    def add_up() -> None:
        for lang, parts in held.items():
            held[lang] = [_distinct([np.concatenate(c) for c in zip(*(rows for rows, _ in parts))], np.concatenate([n for _, n in parts]))]

    def added() -> Iterator[pa.RecordBatch]:
        for lang, [(rows, n)] in held.items():
            for start in range(0, len(n), 50_000):
                part = slice(start, start + 50_000)
                yield pa.record_batch([pa.array([lang] * len(n[part]), pa.string()), *(pa.array(r[part]) for r in rows), pa.array(n[part])], names=["lang", *_columns(max_words), "n"])

    size = 0
    for lang, text in _texts(batches):
        distinct, at, pair = _frequent(text, seed, bits, words)
        h, at = distinct[at], np.flatnonzero(pair)
        on, three = (np.zeros(len(h) + max_words, dtype=bool) for _ in range(2))
        keys, part = _pair_keys(lang, h[at], h[at + 1]), _next_parts(h, pair, at)
        on[at], three[at] = _passes(pairs, keys), (part > 0) & _passes(nexts, _pair_keys(lang, keys, part))
        three[:-1] &= on[:-1] & on[1:]
        at = np.flatnonzero(three)
        h = np.append(h, np.zeros(max_words, dtype=np.int64))
        rows, goes_on = [h[at], h[at + 1]], np.ones(len(at), dtype=bool)
        for d in range(2, max_words):
            goes_on = goes_on & three[at + d - 2]
            rows.append(np.where(goes_on, h[at + d], 0))
        found = _distinct(rows, np.ones(len(at), dtype=np.int64))
        held.setdefault(lang, []).append(found)
        size += len(found[1])
        if size > HELD_ROWS:
            add_up()
            size = sum(len(n) for [(_, n)] in held.values())
            if size > HELD_ROWS // 2:
                yield from added()
                held, size = {}, 0
    add_up()
    yield from added()


class _Growth:
    """Frequent phrases of a stretch of sorted windows, of one language."""

    def __init__(self, words: list[np.ndarray], counts: np.ndarray, min_count: int, edges: tuple[bool, bool]) -> None:
        self.words, self.upto, self.min_count, self.edges = words, np.append(0, np.cumsum(counts)), min_count, edges
        self.phrases: list[list[int]] = []
        self.counts: list[int] = []

    def extend(self, prefix: list[int], start: int, end: int) -> None:
        """Extend ``prefix``, whose projection is the rows from ``start`` to ``end``, by each word that follows it often enough."""
        following = self.words[len(prefix)][start:end]
        cuts = np.flatnonzero(following[1:] != following[:-1]) + 1 + start
        starts, ends = np.append(start, cuts), np.append(cuts, end)
        support = self.upto[ends] - self.upto[starts]
        first, last = self.edges
        open_ended = (first & (starts == 0)) | (last & (ends == len(self.upto) - 1))
        for i in np.flatnonzero((self.words[len(prefix)][starts] != 0) & (open_ended | (support >= self.min_count))).tolist():
            phrase = [*prefix, int(self.words[len(prefix)][starts[i]])]
            if len(phrase) > 1:
                self.phrases.append(phrase)
                self.counts.append(int(support[i]))
            if len(phrase) < len(self.words):
                self.extend(phrase, int(starts[i]), int(ends[i]))


def _mine(max_words: int, min_count: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of two words and more in sorted windows, in stretches of MINED_ROWS; at the ends of one, whatever their counts."""
    held: list[pa.RecordBatch] = []

    def mined() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        codes = langs.indices.to_numpy()
        columns, counts = [rows.column(c).to_numpy() for c in _columns(max_words)], rows.column("n").to_numpy()
        stops = np.append(np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes))
        start = 0
        for stop in stops.tolist():
            growth = _Growth([c[start:stop] for c in columns], counts[start:stop], min_count, (start == 0, stop == len(codes)))
            growth.extend([], 0, stop - start)
            lang = langs.dictionary[int(codes[start])].as_py()
            if growth.counts:
                yield pa.record_batch({"lang": pa.array([lang] * len(growth.counts), pa.string()), "words": pa.array(growth.phrases, pa.list_(pa.int64())), "n": pa.array(growth.counts, pa.int64())})
            start = stop

    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= MINED_ROWS:
            yield from mined()
            held, size = [], 0
    if held:
        yield from mined()


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, seed: int = 0, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``lang, words, n``: all phrases of one to ``max_words`` words that occur ``min_count`` times in their language, as
    hashes of their words; and ``lang, h, word, n`` of the words themselves, with all words of a language as ``h`` 0.

    ``docs`` has ``lang`` and ``text`` without nulls. If a frequent word shares its hash, the next seed is taken.
    """
    max_words = max(2, max_words)
    for turn in range(seed, seed + SEEDS):

        def count(batches: Iterator[pa.RecordBatch], turn=turn) -> Iterator[pa.RecordBatch]:
            return _count_words(turn, bits, batches)

        counted = docs.mapInArrow(count, _WORDS_DDL).groupBy("lang", "h").agg(F.min("word").alias("word"), F.max("word").alias("other"), F.sum("n").alias("n"))
        words = stored(counted.filter((F.col("h") == 0) | (F.col("n") >= min_count)), "words")
        if words.filter("word <> other").isEmpty():
            break
        drop_stored(words)
    else:
        raise RuntimeError(f"hashes of {bits} bits are too few to tell the words apart")
    words = words.drop("other")
    known = words.filter("h <> 0")
    word_bits = _filter_of(known, "h")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_pairs(turn, bits, word_bits, batches)

    # One shuffle serves both counts, so nothing that only one of them needs may be pushed below it: -1 stands for whole
    # pairs, and parts that are 0 are left in. Tasks that read have added theirs already.
    apart = docs.mapInArrow(count_pairs, _PAIRS_DDL).repartition("lang", "h1", "h2")
    times, part = F.shiftright("n", NEXT_BITS), F.col("n").bitwiseAND((1 << NEXT_BITS) - 1)
    whole = apart.groupBy("lang", "h1", "h2").agg(F.lit(-1).cast("long").alias("part"), F.sum(times).alias("n"))
    parted = apart.groupBy("lang", "h1", "h2", part.alias("part")).agg(F.sum(times).alias("n"))
    often = stored(whole.unionByName(parted).filter(F.col("n") >= min_count), "pairs")
    pair_bits, next_bits = (_filter_of(often.filter(kind).select("lang", "h1", "h2", "part").mapInArrow(_filter_keys, "key long"), "key") for kind in ("part < 0", "part > 0"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _find_windows(turn, bits, word_bits, pair_bits, next_bits, max_words, batches)

    columns = _columns(max_words)
    windows = stored(docs.mapInArrow(find, f"lang string, {', '.join(f'{c} long' for c in columns)}, n long"), "windows")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _mine(max_words, min_count, batches)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = windows.repartitionByRange(parts, "lang", *columns).sortWithinPartitions("lang", *columns)
    mined = ranged.mapInArrow(mine, "lang string, words array<long>, n long").groupBy("lang", "words").agg(F.sum("n").alias("n"))
    mined = mined.filter((F.col("n") >= min_count) & (F.size("words") > 2))
    single = known.select("lang", F.array("h").alias("words"), "n")
    pairs = often.filter("part < 0").select("lang", F.array("h1", "h2").alias("words"), "n")
    phrases = stored(mined.unionByName(pairs).unionByName(single), "phrases")
    drop_stored(often)
    drop_stored(windows)
    return phrases, words


def _score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) in whole numbers of up to 38 digits."""
    whole = lambda c: f"cast({c} as decimal(17, 0))"
    return F.expr(f"(cast(1000 as decimal(4, 0)) * {whole(a)} * {whole(n)}) div ({whole(left)} * {whole(right)})")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, cover_percent: int = COVER_PERCENT, seed: int = 0, bits: int = 64
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language by score.

    Null texts are empty and null languages ``und``; rows that repeat count each. Of the cuts of a phrase in two the one
    with the lowest score counts, the first of equal ones. A phrase goes if a longer one that holds it has
    ``cover_percent`` of its occurrences. An empty table, or one without a frequent phrase, gives no rows; other columns
    are never read. Texts are split in numpy, whole, so one may be as long as a task's memory is to some thirty times its
    size; phrases never reach over a stop, so no count depends on how texts are put together.
    """
    own = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    phrases, words = frequent_phrases(own, min_count, max_words, seed, bits)
    totals = words.filter("h = 0").select("lang", F.col("n").alias("total"))
    longer = phrases.filter(F.size("words") > 1).withColumnRenamed("n", "a")
    cuts = longer.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    rest = F.expr("slice(words, k + 1, size(words) - k)")
    cuts = cuts.select("lang", "words", "a", "k", F.expr("slice(words, 1, k)").alias("left"), rest.alias("right"))
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(totals, "lang")
    best = F.min(F.struct(_score("a", "total", "l", "r").alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "words", "a", F.col("total").alias("n")).agg(best)

    sizes = F.sequence(F.lit(2), F.size("words") - 1)
    inner = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.slice("words", i, m))))
    covered = longer.filter(F.size("words") > 2).select("lang", F.explode(inner).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("most"))
    left = scored.join(covered, ["lang", "words"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < cover_percent * F.col("a")))
    left = left.select("lang", "words", "a", "cut.l", "cut.r", "n", "cut.score")
    # Ties at the last rank are told apart by the phrase, which is spelt out for these only.
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = left.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= top).drop("place")
    spelt = first.select("lang", "words", F.posexplode("words").alias("at", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    spelt = spelt.groupBy("lang", "words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = first.join(spelt, ["lang", "words"]).withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND c >= {MIN_COUNT}),
u AS (SELECT lang, k, phrase, a, cut, array_to_string(ws[1 : cut], ' ') AS lw, array_to_string(ws[cut + 1 : k], ' ') AS rw
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT u.lang, u.phrase, u.a, u.k, u.cut, fl.c AS l, fr.c AS r, n.n, ((1000::HUGEINT * u.a * n.n) // (fl.c::HUGEINT * fr.c))::BIGINT AS score
      FROM u JOIN f fl ON fl.lang = u.lang AND fl.phrase = u.lw AND fl.k = u.cut JOIN f fr ON fr.lang = u.lang AND fr.phrase = u.rw AND fr.k = u.k - u.cut
      JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(ws[x : x + m - 1], ' ') AS phrase, max(a) AS most
      FROM (SELECT lang, ws, k, a, m, unnest(range(1, k - m + 2)) AS x FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR 100 * most < {COVER_PERCENT} * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= {TOP}
"""
