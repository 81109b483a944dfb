"""Exact, near and passage deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, simhash, suffix_dedup
from quarry.llm.suffix_sort import suffix_order
from tests.compare import assert_equal, rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, sha256 string, h string, kept boolean, nth string, fp long"


def frame(spark, pairs):
    """Documents with extra columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, "x", "y", None, "z", 1) for i, t in pairs], DOCS).repartition(3)


EDGES = [(1, "a"), (2, None), (3, ""), (4, "a"), (4, "a"), (5, "b" * 200000), (6, "b" * 200000), (7, "b" * 199999 + "c"), (None, "a"), (8, "é\u0000")]


def brute_exact(pairs):
    best: dict = {}
    for i, t in pairs:
        best.setdefault(t or "", []).append(i)
    out = []
    for text, ids in best.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not seen))
            seen = seen or i == keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("primes,huge", [(exact_dedup.PRIMES, exact_dedup.HUGE_BYTES), (exact_dedup.PRIMES, 3), ((7, 5), 3)])
def test_exact_edges(spark, primes, huge, monkeypatch):
    """With tiny primes nearly all fingerprints collide, and only the comparison tells texts apart; rows that share an id, or have none, too."""
    monkeypatch.setattr(exact_dedup, "PIECE_BYTES", 1 << 16)
    monkeypatch.setattr("quarry.llm.common.HOT_SHARE", 20)
    monkeypatch.setattr("quarry.llm.common.HOT_ROWS", 0)
    pairs = EDGES + [(i, f"{i % 9:04d}") for i in range(20, 60)] + [(None, f"{i % 5:04d}") for i in range(9)] + [(77, "0001"), (77, "9999"), (77, "9998"), (77, "9999")]
    got = exact_dedup.exact_groups(frame(spark, pairs), primes=primes, huge=huge)
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=repr)
    assert found == brute_exact(pairs)


def test_exact_query(spark):
    assert_equal(exact_dedup.op4_exact_dedup(spark, SF), exact_dedup.SQL, SF)


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(frame(spark, [])).count() == 0 and simhash.drop_near_copies(frame(spark, [])).count() == 0


def test_a_huge_text_is_hashed_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PIECE_BYTES", 1 << 12)
    text = "".join(chr(97 + i * i % 26) for i in range(300001))
    df = frame(spark, [(1, text), (2, text + "x"), (3, "short")])
    found = exact_dedup.fingerprints(df, huge=1 << 16)
    whole = {r.doc_id: (r.n_bytes, r.fp1, r.fp2, r.sha256) for r in exact_dedup.fingerprints(df).collect()}
    assert {r.doc_id: (r.n_bytes, r.fp1, r.fp2, r.sha256) for r in found.collect()} == whole
    assert "start_word" in found._jdf.queryExecution().optimizedPlan().toString()


def test_drop_exact_copies(spark):
    got = exact_dedup.drop_exact_copies(frame(spark, EDGES))
    assert got.columns == frame(spark, []).columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(3, ""), (4, "a"), (6, "b" * 200000), (7, "b" * 199999 + "c"), (8, "é\u0000")])
    unique = exact_dedup.drop_exact_copies(frame(spark, [(1, "a"), (2, "a"), (3, None)]))
    assert sorted(r.doc_id for r in unique.collect()) == [2, 3]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=6))
def test_chunked_fingerprint_is_whole(texts):
    small, large = exact_dedup.Fingerprinter(chunk_bytes=8), exact_dedup.Fingerprinter(chunk_bytes=1 << 12)
    for a, b in zip(small.texts(texts), large.texts(texts)):
        assert a.tolist() == b.tolist()


def test_combine_chunks(spark):
    maker = exact_dedup.Fingerprinter(chunk_bytes=8)
    texts = {1: b"some longer text, cut in parts", 2: b"short"}
    parts = []
    for key, t in texts.items():
        _, (h1, h2) = maker.chunk_hashes([t])
        parts += [(key, i * 2, int(a), int(b)) for i, (a, b) in enumerate(zip(h1, h2))]
    random.Random(1).shuffle(parts)
    got = {r.k: (r.fp1, r.fp2) for r in exact_dedup.combine_chunks(spark.createDataFrame(parts, "k int, start_word long, h1 long, h2 long"), "k").collect()}
    for key, t in texts.items():
        a, b = maker.texts([t])
        assert got[key] == (a[0], b[0])


def brute_simhash(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, links):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


@pytest.mark.parametrize("segments", [5, 8, 12, 16])
def test_links_lose_nothing(spark, segments):
    rng = random.Random(segments)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            f = base
            for _ in range(rng.randint(0, 6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 4]
    expected = brute_components(fps, near)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    found = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, 4, segments, held=7 if segments in (8, 12) else simhash.HELD).collect()}
    assert found <= {tuple(sorted(p)) for p in near} | {tuple(sorted(p, reverse=True)) for p in near}
    assert brute_components(fps, found) == expected


def test_large_group_forest(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(3)
    fps = np.unique(np.array([sum(1 << rng.randrange(12) for _ in range(3)) for _ in range(300)], dtype=np.uint64))
    ring = simhash.Ring(4, 8)
    start = 4  # all differences lie outside of the segments from here
    found = ring.forest(fps, start)
    near = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if ring.linked(np.array([a]), np.array([b]), start)[0]]
    assert brute_components(fps.tolist(), found) == brute_components(fps.tolist(), near)
    assert len(found) < len(fps)


def test_a_hot_key_is_dealt_out(spark, monkeypatch):
    """All fingerprints share the bits of a key; far more than a task holds."""
    monkeypatch.setattr("quarry.llm.common.HOT_SHARE", 10)
    monkeypatch.setattr("quarry.llm.common.HOT_ROWS", 0)
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 40, 12000).astype(np.int64) << 22 | 5
    near = fps[:3000] ^ (np.int64(7) << rng.integers(22, 58, 3000))
    df = spark.createDataFrame([(int(f),) for f in np.concatenate([fps, near])], "fp long")
    edges = simhash.links(df, held=1000)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(found[min(int(a), int(b))] == found[max(int(a), int(b))] for a, b in zip(fps[:3000], near))
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= 4 for r in edges.collect())


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr("quarry.llm.common.HOT_SHARE", 10)
    monkeypatch.setattr("quarry.llm.common.HOT_ROWS", 0)
    edges = [(50, i) for i in range(400) if i != 50] + [(500 + i, 501 + i) for i in range(20)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(400)}, **{500 + i: 500 for i in range(21)}}


def test_near_groups(spark):
    pairs = [(5, "one two three four five"), (3, "One TWO three four five"), (9, None), (2, " \n"), (None, ""), (7, "x"), (7, "x"), (11, "É é"), (12, "k " * 5000)]
    got = simhash.near_groups(frame(spark, pairs)).collect()
    by = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr)
    fps = {(i, brute_simhash(t)) for i, t in pairs}
    assert {(i, f) for i, f, _ in by} == fps and len(by) == len(pairs)
    component = {i: c for i, _, c in by}
    assert component[5] == component[3] == 3 and component[9] == component[2] == component[None] == 2 and component[7] == 7
    assert simhash.near_groups(frame(spark, [])).count() == 0
    kept = simhash.drop_near_copies(frame(spark, pairs))
    assert kept.columns == frame(spark, []).columns and {r.doc_id for r in kept.collect()} == {3, 2, 7, 11, 12}


def test_simhash_query(spark):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.op6_simhash(spark, SF).collect()}
    docs = {r.doc_id: brute_simhash(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {i: f for i, (f, _) in got.items()} == docs
    fps = sorted(set(docs.values()))
    label = brute_components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 4])
    smallest: dict = {}
    for i, f in docs.items():
        smallest[label[f]] = min(i, smallest.get(label[f], i))
    assert {i: c for i, (_, c) in got.items()} == {i: smallest[label[f]] for i, f in docs.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_order(symbols):
    a = np.array(symbols, dtype=np.int64)
    assert suffix_order(a).tolist() == sorted(range(len(a)), key=lambda i: symbols[i:])


def brute_repeats(pairs, length):
    """Documents in order, with rows of one id by the operator's own tie rule left out: ids are distinct here."""
    seen, out = set(), {}
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            s = raw[at : at + length]
            if s in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), sum(gone), spans, bytes(x for x, g in zip(raw, gone) if not g))
    return out


def found_repeats(df):
    return {r.doc_id: (len(r.raw), len(r.raw) - len(r.kept), len(r.spans), bytes(r.kept)) for r in df.collect()}


@pytest.mark.parametrize("length,gram,hot,seed", [(100, 24, 8000, 1), (100, 24, 2, 2), (12, 5, 8000, 3), (12, 5, 1, 4), (200, 40, 8000, 5), (6, 6, 3, 6)])
def test_repeats(spark, length, gram, hot, seed):
    rng = random.Random(seed)
    passage = ["".join(rng.choices("abcde fé", k=rng.randint(length // 2, 4 * length))) for _ in range(6)]
    pairs = [(None, passage[0]), (-3, None), (50, ""), (51, "a" * (5 * length)), (52, "ab" * (3 * length)), (53, "a" * (2 * length)), (60, "é" * length), (54, passage[1] * 3)]
    for i in range(40):
        pairs.append((i, "".join(rng.choice([*passage, "".join(rng.choices("abcde", k=rng.randint(0, 2 * length)))]) for _ in range(rng.randint(1, 5)))))
    got = found_repeats(suffix_dedup.repeats(frame(spark, pairs), length=length, gram=gram, hot=hot))
    assert got == brute_repeats(pairs, length)


@pytest.mark.parametrize("hot", [8000, 3])
def test_anchor_hashes_that_collide(spark, monkeypatch, hot):
    """Nearly all anchors share a hash: many different stretches meet, and only their bytes tell them apart."""
    rng = random.Random(9)
    passage = ["".join(rng.choices("abcde fé", k=rng.randint(15, 60))) for _ in range(5)]
    pairs = [(i, "".join(rng.choice([*passage, "".join(rng.choices("abcde", k=rng.randint(0, 30)))]) for _ in range(4))) for i in range(40)]
    meet = suffix_dedup.meet_anchors
    settled = F.col("sign").bitwiseAND(suffix_dedup.SETTLED) > 0
    monkeypatch.setattr(suffix_dedup, "meet_anchors", lambda runs, hot: meet(runs.withColumn("h", F.when(settled, F.col("h")).otherwise(F.pmod("h", F.lit(3)))), hot))
    assert found_repeats(suffix_dedup.repeats(frame(spark, pairs), length=12, gram=5, hot=hot)) == brute_repeats(pairs, 12)


@pytest.mark.parametrize("bits, hot", [(0, 8000), (0, 2), (2, 3), (3, 8000)])
def test_claims_that_do_not_hold(spark, bits, hot):
    """Hashes of few bits: different stretches claim to be equal, in chains, and go to the sort instead."""
    rng = random.Random(10 + bits)
    passage = ["".join(rng.choices("abcde fé", k=rng.randint(15, 60))) for _ in range(5)]
    pairs = [(i, "".join(rng.choice([*passage, "".join(rng.choices("abcde", k=rng.randint(0, 30)))]) for _ in range(4))) for i in range(40)]
    pairs += [(i, "".join(rng.choices("abcde", k=120))) for i in range(40, 46)] + [(46, "ab" * 80), (47, pairs[3][1][5:] + "ab" * 20)]
    assert found_repeats(suffix_dedup.repeats(frame(spark, pairs), length=12, gram=5, hot=hot, bits=bits)) == brute_repeats(pairs, 12)


def test_many_long_stretches_of_one_anchor():
    """2.6 MB of different stretches in one block: names of their triples don't fit 21 bits."""
    rng = random.Random(11)
    stretches = [((i, 5), rng.randbytes(327)) for i in range(8000)]
    stretches[7999] = ((7999, 5), stretches[4000][1][20:300] + rng.randbytes(47))
    assert suffix_dedup.later_strings(stretches, 200) == [(7999, 0, 80)]


def test_strings_that_share_places():
    """A text that is given twice, cut in different ways, is no copy of itself."""
    text = random.Random(12).randbytes(300)
    assert suffix_dedup.later_strings([((1, 0), text[:200]), ((1, 50), text[50:])], 100) == []
    assert suffix_dedup.later_strings([((1, 0), text[:200]), ((1, 50), text[50:]), ((2, 7), text[90:250])], 100) == [(2, 0, 60)]


def test_suffix_order_of_large_symbols():
    symbols = np.random.default_rng(1).integers(0, 3, 300) + (1 << 22) - 3
    assert suffix_order(symbols).tolist() == sorted(range(300), key=lambda i: symbols[i:].tolist())


def test_seeds_change_hashes_and_not_results(spark):
    text = "".join(random.Random(3).choices("abcdefgh ", k=700))
    pairs = [(1, text), (2, text[100:500]), (3, "x" + text[300:] + text[:300])]
    once, again = (suffix_dedup.repeats(frame(spark, pairs), seed=seed) for seed in (1, 2))
    assert found_repeats(once) == found_repeats(again) == brute_repeats(pairs, 100)


def test_claims_are_on_the_copy_before(spark):
    """Each claim has the bytes of all its strings, and is on the copy next to it in the order of ids."""
    text = "".join(random.Random(4).choices("abcdefgh ", k=9000))
    rows = suffix_dedup.keyed(frame(spark, [(1, text), (2, "start " + text), (3, text)]).coalesce(1).repartition(3, "doc_id"))
    places = suffix_dedup._with_places(rows, suffix_dedup.meet_anchors(suffix_dedup.anchor_runs(rows, suffix_dedup.Anchors())))
    whole = suffix_dedup._claims(places, 100).collect()
    assert whole and all(bytes(r.bytes) in text.encode() and len(r.bytes) == r.last - (r.loc & (1 << 40) - 1) + 100 for r in whole)
    assert {(r.k, r.k0) for r in whole} <= {(2, 1), (3, 2), (3, 1)}


def test_repeats_of_one_id(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=300))
    got = suffix_dedup.repeats(frame(spark, [(1, text), (1, text), (1, "x" + text)])).collect()
    assert sorted(len(r.raw) - len(r.kept) for r in got)[0] == 0 and sum(len(r.raw) - len(r.kept) for r in got) >= 600
    assert suffix_dedup.repeats(frame(spark, [])).count() == 0


def test_passages_query(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op1_suffix_array_dedup(spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == {i: (n, g, s, hashlib.sha256(k).hexdigest()) for i, (n, g, s, k) in brute_repeats(docs, 100).items()}
    assert sum(v[1] for v in got.values()) > 0


def test_drop_repeats_keeps_columns_and_characters(spark):
    text = "é" * 60 + "".join(random.Random(2).choices("abcdefgh ", k=300))
    df = frame(spark, [(1, text), (2, "start " + text), (3, None)]).withColumn("n_chars", F.length("text"))
    out = suffix_dedup.drop_repeats(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == text or len(got[1].text) < len(text)
    assert got[2].text == "start " and got[2].n_chars == 6 and got[3].text == "" and got[2].sha256 == "x"
    assert rows(out.select("h").toPandas()) == [("y",)] * 3
