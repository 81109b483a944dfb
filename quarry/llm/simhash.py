"""SimHash near-deduplication with pigeonring filtering.

A 64-bit fingerprint is cut into ``m`` segments set on a ring. If two fingerprints differ in at most ``t`` bits, the
pigeonring principle gives a start on the ring from which, for every ``l``, the first ``l`` segments together differ
in at most ``l * t / m`` bits. The segments at the head of such a chain whose budget is below 1 must be equal, and of
those whose budget is below 2 at most one may differ. These two facts make the keys under which fingerprints meet;
inside a key, pairs must pass the whole chain before their full Hamming distance is taken. No link is lost.

Only distinct fingerprints are searched, a key gives a spanning forest of its links rather than all pairs, and
components come from alternating star contractions in Spark. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop_stored, join_spread, stored, table, utf8

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEGMENTS = 12
BLOCK = 1024
#: Fingerprints of one key that a task compares; those of keys with more are dealt out by pairs of blocks.
HELD = 1 << 14


def simhash(raw: bytes, width: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text given as UTF-8 bytes; zero without words."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype=np.uint64, count=max(1, len(words) - width + 1))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        octets = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row; null text is empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = np.array([simhash(t, width) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("raw")).mapInArrow(run, "doc_id long, fp long")


class Ring:
    """Segment masks, chain budgets and meeting keys of a ring of ``segments`` parts for ``distance`` bits."""

    def __init__(self, distance: int = MAX_DISTANCE, segments: int = SEGMENTS):
        if not 0 <= distance < segments <= 64:
            raise ValueError("need 0 <= distance < segments <= 64")
        self.distance, self.segments = distance, segments
        cuts = [64 * i // segments for i in range(segments + 1)]
        self.masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
        self.budgets = [n * distance // segments for n in range(1, segments + 1)]
        equal = sum(b == 0 for b in self.budgets)
        one_off = sum(b == 1 for b in self.budgets)
        self.key_masks: list[tuple[int, int]] = []
        for start in range(segments):
            ring = [self.masks[(start + i) % segments] for i in range(equal + one_off)]
            for skip in range(max(1, one_off)):
                self.key_masks.append((start, sum(m for i, m in enumerate(ring) if i != equal + skip)))

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """A row of keys for each fingerprint; the low 16 bits tell the kind of key."""
        out = np.empty((len(fps), len(self.key_masks)), dtype=np.uint64)
        for tag, (_, mask) in enumerate(self.key_masks):
            mixed = (fps & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            out[:, tag] = (mixed ^ (mixed >> np.uint64(29))) & np.uint64(2**64 - 65536) | np.uint64(tag)
        return out

    def linked(self, a: np.ndarray, b: np.ndarray, start: int) -> np.ndarray:
        """Which pairs pass the chain from ``start`` and then the full check."""
        differ = a ^ b
        alive = np.ones(differ.shape, dtype=bool)
        mask = 0
        for i, budget in enumerate(self.budgets[:-1]):
            mask |= self.masks[(start + i) % self.segments]
            alive &= np.bitwise_count(differ & np.uint64(mask)) <= budget
            if not alive.any():
                return alive
        return alive & (np.bitwise_count(differ) <= self.distance)

    def forest(self, fps: np.ndarray, start: int, split: int = 0) -> list[tuple[int, int]]:
        """Links that connect all of ``fps`` that links connect, at most one fewer than there are fingerprints.

        Blocks are compared with blocks; once a block has become one component, only what lies outside of it matters.
        With ``split`` the fingerprints before it are compared with those behind it only.
        """
        n = len(fps)
        parent = np.arange(n)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return int(i)

        out = []
        for hub in (0, n // 2) if n > BLOCK and not split else ():
            for j in np.flatnonzero(self.linked(fps[hub], fps, start)).tolist():
                x, y = root(hub), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(fps[hub]), int(fps[j])))
        for i in range(0, split or n, BLOCK):
            ends = min(i + BLOCK, split or n)
            for j in range(split or i, n, BLOCK):
                left = np.array([root(k) for k in range(i, ends)])
                right = left if i == j else np.array([root(k) for k in range(j, min(j + BLOCK, n))])
                if left.min() == left.max() == right.min() == right.max():
                    continue
                near = self.linked(fps[i:ends, None], fps[None, j : j + BLOCK], start)
                rows, cols = np.nonzero(near & (left[:, None] != right[None, :]))
                for r, c in zip(rows.tolist(), cols.tolist()):
                    x, y = root(i + r), root(j + c)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((int(fps[i + r]), int(fps[j + c])))
        return out


def _links_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1)), pa.array(np.zeros(len(pairs), dtype=bool))], ["a", "b", "more"])


def enough_segments(n: int, distance: int = MAX_DISTANCE) -> int:
    """Segments whose keys are long enough for ``n`` distinct fingerprints: of random ones, a key has a few dozen at most."""
    choices = [min(64, max(1, times * distance)) for times in (3, 4, 6)]
    return next((m for m in choices if n >> min(mask.bit_count() for _, mask in Ring(distance, m).key_masks) < 64), choices[-1])


def links(fps: DataFrame, distance: int = MAX_DISTANCE, segments: int = SEGMENTS, held: int = HELD) -> DataFrame:
    """Links ``a < b`` between distinct fingerprints (column ``fp``) that connect all within ``distance`` bits.

    A task compares up to ``held`` fingerprints of one key. Those of a key with more are dealt into blocks of that size,
    and every two blocks meet in a task of their own, so no key is bound to one task.
    """
    ring = Ring(distance, segments)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                got = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                keys = ring.keys(got)
                flat = [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(got, keys.shape[1]).view(np.int64))]
                yield pa.RecordBatch.from_arrays(flat, ["key", "fp"])

    def within(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        """Links inside the groups of equal keys, all of them whole."""
        edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(edges, len(keys)))
        found: list[tuple[int, int]] = []
        tags = keys[edges] & np.uint64(65535)
        two = edges[sizes == 2]
        for tag, (start, _) in enumerate(ring.key_masks):
            at = two[tags[sizes == 2] == tag]
            if len(at):
                hit = at[ring.linked(fps[at], fps[at + 1], start)]
                found.extend(zip(fps[hit].tolist(), fps[hit + 1].tolist()))
        for i in np.flatnonzero(sizes > 2).tolist():
            found.extend(ring.forest(fps[edges[i] : edges[i] + sizes[i]], ring.key_masks[int(tags[i])][0]))
        return _links_of(found)

    def passed_on(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(np.ones(len(keys), dtype=bool))], ["a", "b", "more"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``more`` is false in links, and true in ``key, fp`` rows of keys with too many fingerprints for one task."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting, over = 0, None
        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if over is not None:
                same = int(np.searchsorted(keys != over, True))
                if same:
                    yield passed_on(keys[:same], fps[:same])
                keys, fps = keys[same:], fps[same:]
            if not len(keys):
                continue
            over = None
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if last or (parts and parts[-1][0][-1] != keys[0]):
                cut = last or 0
                parts.append((keys[:cut], fps[:cut]))
                yield within(*(np.concatenate(p) for p in zip(*parts)))
                parts, waiting = [], 0
            parts.append((keys[last:], fps[last:]))
            waiting += len(keys) - last
            if waiting > held:
                over = keys[-1]
                for part in parts:
                    yield passed_on(*part)
                parts, waiting = [], 0
        if parts:
            yield within(*(np.concatenate(p) for p in zip(*parts)))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks ``i`` and ``j`` of a key, sorted by key, pair and block, of which a task holds one pair at a time."""
        now, sides = None, ([], [])

        def close() -> pa.RecordBatch:
            key, i, j = now
            first, second = (np.unique(np.array(side, dtype=np.int64).view(np.uint64)) for side in sides)
            start = ring.key_masks[key & 65535][0]
            if i == j:
                return _links_of(ring.forest(first, start))
            return _links_of(ring.forest(np.concatenate([first, second]), start, len(first)) if len(first) and len(second) else [])

        for batch in batches:
            for key, i, j, block, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != now:
                    if now is not None:
                        yield close()
                    now, sides = (key, i, j), ([], [])
                sides[block != i].append(fp)
        if now is not None:
            yield close()

    keyed = fps.select("fp").distinct().mapInArrow(emit, "key long, fp long")
    met = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(meet, "a long, b long, more boolean")
    met = stored(met, "met")
    found, more = met.filter("NOT more").select("a", "b"), met.filter("more").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if not more.isEmpty():
        blocks = more.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("n"), F.count(F.lit(1)).alias("rows"))
        dealt = join_spread(more, blocks, ["key"], "rows", more.count()).withColumn("block", F.pmod(F.xxhash64("fp"), "n").cast("int"))
        pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        pairs = pairs.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
        pairs = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block")
        found = found.unionByName(pairs.mapInArrow(cross, "a long, b long, more boolean").select("a", "b"))
    return found.filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an undirected graph: root is the smallest node reachable.

    Alternating large-star and small-star steps; each step is two grouped minima and joins, written to the shared
    folder, until a round changes nothing. Rounds grow with the logarithm of the longest path.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_spread(both, low, ["u"], "n", before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_spread(large, low, ["u"], "n", before[0])
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        after = stored(small.filter("u <> v").distinct(), "edges")
        drop_stored(now)
        now, last, before = after, before, mark(after)
        if before == last:
            break
    members = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    roots = now.select(F.col("v").alias("node")).distinct().join(members.select("node"), "node", "left_anti")
    return members.unionByName(roots.select("node", F.col("node").alias("root")))


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE, segments: int | None = None
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; component_id is the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat an id are rows of their own.
    Null ids are never the smallest unless a component has no other. An empty table gives no rows. ``segments`` follows
    the number of distinct fingerprints if not given; the result doesn't depend on it.
    """
    prints = stored(fingerprints(docs, key, text), "simhash")
    first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "prints")
    totals = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = stored(components(links(first, distance, segments or enough_segments(totals[0], distance))), "roots")
    joined = first.join(found, first.fp == found.node, "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    classes = join_spread(joined, smallest, ["root"], "prints", totals[0]).select("fp", "n", "component_id")
    return join_spread(prints, classes, ["fp"], "n", totals[1]).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with their own columns.

    Rows that share an id are one document: they stay together if that id is the smallest of any of their components.
    """
    kept = near_groups(docs, key, text).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
    return docs.join(kept, docs[key].eqNullSafe(kept["__id"]), "left_semi")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
