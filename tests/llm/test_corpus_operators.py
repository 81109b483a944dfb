"""Source divergence, WARC archives and phrase collocations."""

import gzip
import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import collocations, divergence, warc
from tests.compare import assert_equal

SF = "/root/testdata/sf0.001"


def test_queries_equal_sql(spark):
    assert_equal(divergence.op11_source_divergence(spark, SF), divergence.SQL, SF)
    assert_equal(warc.op12_warc(spark, SF), warc.SQL, SF)
    assert_equal(collocations.op13_collocations(spark, SF), collocations.SQL, SF)


def audit_brute(rows, min_docs, top):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))) for text, lang, source in rows]
    groups = defaultdict(set)
    for lang, source, _ in docs:
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        df = Counter(t for one, _, terms in docs if one == lang for t in set(terms))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        count = {s: Counter(t for one, x, terms in docs if (one, x) == (lang, s) for t in terms if df[t] >= min_docs) for s in sources}
        total = sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p(count[s], t), p(count[o], t)) for t in kept), o.encode(), o) for o in sources - {s}]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            terms = [(-f(p(count[s], t), p(total, t)), t.encode(), t) for t in kept if count[s][t] and p(count[s], t) > p(total, t)]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [(50_000, 500_000), (3, 3)])
def test_audit_equals_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(divergence, "SHARD_ROWS", shard_rows)
    rnd = random.Random(5)
    terms = ["a", "b", "É", "zz", "ñandú", "语", "Word", "word", "x" * 40]
    rows = [(" ".join(rnd.choices(terms, weights=range(1, 10), k=rnd.randint(0, 12))) + rnd.choice(["", ".", "1a2", "\x00"]), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "é", None, ""])) for _ in range(80)]
    rows += [rows[0]] * 3 + [(None, "en", "empty"), ("", "xx", "alone"), ("q", "xx", "other"), ("long " + "word " * 400_000, "en", "s1")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "text string, lang string, source string, term string, shard int").repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(df, min_docs=3, top=4).collect())
    assert got == audit_brute(rows, 3, 4)
    assert divergence.audit(df.limit(0)).count() == 0


def test_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 5)
    assert divergence._cut(b"ab cd efghijkl m  n") == [b"ab cd", b"efghijkl", b"m  n"]
    assert divergence._cut(b"abcdefghij") == [b"abcdefghij"] and divergence._cut(b"") == [b""]


PAYLOADS = ["", "x", "\r\n\r\n", "a\r\n", "a\r", "\r", "\r\r\n\r\n", "\n\r\n\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "é語" * 400, "a\r\n\r\n" * 300, " lead", "\x00\x01" * 600]


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.example.org/p?q={i % 4}", p) for i, p in enumerate(PAYLOADS * 3)]
    rows += [(100, None, None), (None, "http://a b.org/\r\nX: y", "é語" * 400), (101, "", "same" * 300), (101, "", "same" * 300), (7, "x", "same" * 300), (None, None, None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, payload string, same string").repartition(3)
    path = str(tmp_path / "archives")
    warc.write_warc(df, path)
    got = warc.read_index(spark, path).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    key = lambda x: tuple((v is None, v) for v in x)
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        best = max((p for p, _, h in rows if (h or "").encode() == data and p is not None), default=None)
        again = len(data) >= 1000 and best is not None and (page is None or page < best)
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best if again else None))
    found = [(r.page and int(r.page), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got]
    assert sorted(found, key=key) == sorted(expected, key=key)
    keys = [bytes(r.key) for r in sorted(got, key=lambda r: (r.range, r.nth))]
    assert keys == sorted(keys) and {r.url for r in got} >= {"http://a%20b.org/%0D%0AX:%20y", None}
    assert warc.read_index(spark, path).filter("record_type = 'revisit'").count() == sum(e[3] == "revisit" for e in expected)
    empty = str(tmp_path / "none")
    warc.write_warc(df.limit(0), empty)
    assert warc.read_index(spark, empty).count() == 0


def test_bytes_dates_and_ids_of_other_kinds(spark, tmp_path):
    rows = [("a/ü 1", "http://www.Example.org:80/X#y", bytearray(range(256)) * 8, "2024-05-01T00:00:00Z"), ("b>", "http://example.org/x", bytearray(range(256)) * 8, "2023-05-01T00:00:00Z")]
    df = spark.createDataFrame(rows, "k string, u string, body binary, seen string")
    path = str(tmp_path / "bytes")
    warc.write_warc(df, path, key="k", url="u", html="body", date="seen")
    got = sorted(warc.read_index(spark, path).collect(), key=lambda r: (r.range, r.nth))
    assert [(r.page, r.date, r.record_type, r.refers_to, r.payload_bytes, r.intact) for r in got] == [
        ("b>", "2023-05-01T00:00:00Z", "response", None, 2048, True),
        ("a/ü 1", "2024-05-01T00:00:00Z", "revisit", "b>", 2048, True),
    ]


def test_archives_of_other_writers(spark, tmp_path):
    record = lambda kind, body, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:uuid:1>\r\n{more}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    http = "HTTP/1.1 200 OK\r\n\r\nbody"
    good = tmp_path / "good"
    good.mkdir()
    parts = [record("warcinfo", "software: x\r\n"), record("response", http, "WARC-Target-URI: http://a.org/\r\n"), record("response", http, "WARC-Payload-Digest: sha1:0000\r\n"), record("request", "")]
    (good / "x.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    got = sorted(warc.read_index(spark, str(good)).collect(), key=lambda r: r.offset)
    assert [(r.url, r.page, r.payload_bytes, r.intact) for r in got] == [("http://a.org/", None, 4, True), (None, None, 4, False)]
    for name, data in (("cut", parts[1][:-9]), ("other", b"no archive\r\n\r\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc.gz").write_bytes(gzip.compress(data))
        with pytest.raises(Exception, match="ends within|has no record"):
            warc.read_index(spark, str(tmp_path / name)).count()


def test_url_keys():
    assert warc.url_key("HTTP://user@www.Example.ORG:8080/A?b#c") == "org,example:8080)/a?b"
    assert warc.url_key("https://a.b.com") == "com,b,a)/" and warc.url_key(None) == "" and warc.url_key("?x") == ")/?x"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=2), min_size=1, max_size=9), max_size=9))
def test_loser_tree_merges(runs):
    blocks = []
    for run in runs:
        rows = [dict.fromkeys(warc._CAPTURE.names) | {"key": k} for k in sorted(run)]
        blocks += [warc._block(pa.Table.from_pylist(rows[i : i + 4], schema=warc._CAPTURE)) for i in range(0, len(rows), 4)]
    pairs = sorted((b.column("first")[0].as_py(), b.column("block")[0].as_py()) for b in blocks)
    assert [t.column("key")[i].as_py() for t, i in warc.merged(pairs)] == sorted(k for run in runs for k in run)


def test_blocks_are_cut_at_bounds():
    rows = pa.Table.from_pylist([dict.fromkeys(warc._CAPTURE.names) | {"key": bytes([k])} for k in (1, 3, 3, 5, 9)], schema=warc._CAPTURE)
    got = [(r, warc._unpacked(b).column("key").to_pylist()) for batch in warc._cut_blocks([b"\x02", b"\x03", b"\x07"], [warc._block(rows)]) for r, b in zip(batch.column("range").to_pylist(), batch.column("block").to_pylist())]
    assert got == [(0, [b"\x01"]), (2, [b"\x03", b"\x03", b"\x05"]), (3, [b"\x09"])]


def collocations_brute(rows, min_count, max_words, top, cover):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {w: a for w, a in counts.items() if len(w) > 1 and a >= min_count}
        ranked = []
        for w, a in found.items():
            inside = lambda x, w=w: len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))
            if any(inside(x) and 100 * b >= cover * a for x, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[w[:k]] * counts[w[k:]]), k) for k in range(1, len(w)))
            ranked.append((-score, -a, " ".join(w).encode(), " ".join(w), counts[w[:k]], counts[w[k:]]))
        out += [(lang, i + 1, phrase, -a, left, right, n[lang], -score) for i, (score, a, _, phrase, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.mark.parametrize("min_count, max_words, top, cover, bits", [(3, 5, 40, 100, 64), (2, 3, 7, 60, 64), (4, 5, 1000, 100, 12)])
def test_collocations_equal_brute_force(spark, min_count, max_words, top, cover, bits):
    rnd = random.Random(min_count)
    words = ["the", "of", "New", "york", "Été", "a-b", "x y", "語", "to", "be"]
    rows = [("".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "de", None])) for _ in range(50)]
    rows += [rows[0]] * 5 + [(None, "en"), ("", "fr"), ("the the the the the the", "en"), ("to be or not to be, " * 3000, "de"), ("...;", "fr")]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "text string, lang string, words string, n int, h int").repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(df, min_count=min_count, max_words=max_words, top=top, cover_percent=cover, bits=bits).collect())
    assert got == collocations_brute(rows, min_count, max_words, top, cover)


def test_collocations_of_nothing_and_of_too_few_hash_bits(spark):
    df = spark.createDataFrame([("a b c d e f g h i j k", "en")] * 5, "text string, lang string")
    assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(df).count() == 0
    with pytest.raises(RuntimeError, match="too few"):
        collocations.collocations(df, min_count=2, bits=2)


def test_windows_end_where_no_triple_is_frequent(spark, monkeypatch):
    """Pairs that are all frequent make no long windows where no word follows a pair often enough."""
    rnd = random.Random(8)
    rows = [(" ".join(f"w{rnd.randrange(12)}" for _ in range(100)), "en") for _ in range(200)]
    made, keep = {}, collocations.stored

    def watched(df, label):
        out = keep(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(collocations, "stored", watched)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    got = sorted(tuple(r) for r in collocations.collocations(df, min_count=80).collect())
    assert got == collocations_brute(rows, 80, 5, 2000, 100) and len(got) > 100
    assert made["windows"] <= 2 * 144


def test_windows_begin_where_a_triple_is_frequent(spark, monkeypatch):
    """Frequent pairs are counted in the pass over pairs, whose shuffle is made once, and begin no window."""
    rnd = random.Random(9)
    rows = [(" ".join(f"w{rnd.randrange(12)}" for _ in range(100)), "en") for _ in range(200)] + [("a b c d. b c", "en"), ("b c d", "de")] * 60
    kept, plans, keep = {}, {}, collocations.stored

    def watched(df, label):
        df.collect()
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        out = keep(df, label)
        kept[label] = out.collect()
        return out

    monkeypatch.setattr(collocations, "stored", watched)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, min_count=60).collect())
    assert got == collocations_brute(rows, 60, 5, 2000, 100)
    pairs, triples = ([r for r in kept["pairs"] if r["part"] * sign > 0] for sign in (-1, 1))
    assert len(pairs) == 144 + 3 + 2 and len(triples) == 3
    assert sum(r["n"] for r in kept["windows"]) == 3 * 60 and all(r["w3"] for r in kept["windows"])
    assert "ReusedExchange" in plans["pairs"]


def pairs_of(batches):
    """What a task of the pass over pairs sends out, added up."""
    bits = np.full(1 << (collocations.FILTER_BITS - 6), np.iinfo(np.uint64).max, dtype=np.uint64)
    got = Counter()
    for batch in collocations._count_pairs(0, 64, bits, iter(batches)):
        for lang, h1, h2, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "h1", "h2", "n"))):
            got[lang, h1, h2, n & (1 << collocations.NEXT_BITS) - 1] += n >> collocations.NEXT_BITS
    return got


@pytest.mark.parametrize("code_bits, held_pairs, held_rows", [(20, 4_000_000, 1_000_000), (20, 50, 20), (20, 50, 1_000), (3, 50, 1_000), (1, 7, 3)])
def test_pairs_are_whole_however_few_words_have_numbers(monkeypatch, code_bits, held_pairs, held_rows):
    rnd = random.Random(4)
    rows = [(rnd.choice(["en", "de"]), "".join(f"w{int(rnd.paretovariate(0.7))}" + rnd.choice(" ,   ") for _ in range(rnd.randint(0, 40)))) for _ in range(60)]
    expected = Counter()
    for lang, text in rows:
        for piece in text.split(","):
            h = collocations._hashes(pa.array(piece.split() or [""]), 0, 64)
            parts = collocations._next_parts(h, np.ones(len(h) - 1, dtype=bool), np.arange(len(h) - 1)).tolist()
            expected.update((lang, *key) for key in zip(h[:-1].tolist(), h[1:].tolist(), parts))
    for name, value in (("CODE_BITS", code_bits), ("HELD_PAIRS", held_pairs), ("HELD_ROWS", held_rows), ("TEXT_BYTES", 300)):
        monkeypatch.setattr(collocations, name, value)
    assert pairs_of(pa.record_batch({"lang": [lang], "text": [text]}) for lang, text in rows) == expected


def test_pairs_are_held_in_few_bytes():
    """A million different pairs in one task: 16 MB as they are found, and never much more than three times that with what adding up takes."""
    rnd = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rnd.integers(0, 5_000, 50_000)) for _ in range(40)]
    batches = [pa.record_batch({"lang": ["en"], "text": [text]}) for text in texts]
    tracemalloc.start()
    try:
        bits = np.full(1 << (collocations.FILTER_BITS - 6), np.iinfo(np.uint64).max, dtype=np.uint64)
        before, _ = tracemalloc.get_traced_memory()
        pairs = sum(int((b.column("n").to_numpy() >> collocations.NEXT_BITS).sum()) for b in collocations._count_pairs(0, 64, bits, iter(batches)))
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert pairs == 40 * 49_999
    assert most - before < 120e6, most - before


def test_words_and_windows_are_added_up_before_they_go_out(monkeypatch):
    """A task that reads few words again and again in short texts sends each word, and each window, once."""
    monkeypatch.setattr(collocations, "HELD_ROWS", 100)
    monkeypatch.setattr(collocations, "TEXT_BYTES", 30)
    rows = [pa.record_batch({"lang": ["en", "de"], "text": ["a b c d e f, a b c d e f", "a b c"]})] * 50
    words = [r for b in collocations._count_words(0, 64, iter(rows)) for r in b.to_pylist()]
    assert sorted((r["lang"], r["word"] or "", r["n"]) for r in words) == sorted([("en", "", 600), ("de", "", 150), *(("en", w, 100) for w in "abcdef"), *(("de", w, 50) for w in "abc")])
    every = np.full(1 << (collocations.FILTER_BITS - 6), np.iinfo(np.uint64).max, dtype=np.uint64)
    windows = [r for b in collocations._find_windows(0, 64, every, every, every, 5, iter(rows)) for r in b.to_pylist()]
    assert sorted((r["lang"], r["n"]) for r in windows) == [("de", 50), *[("en", 100)] * 4]


def test_prefixes_over_the_ends_of_stretches(monkeypatch):
    """Counts of phrases that reach over the ends of stretches are in parts that add up."""
    rnd = np.random.default_rng(3)
    rows = sorted(tuple(r) for r in rnd.integers(1, 4, (300, 5)).tolist())
    rows = [r[:k] + (0,) * (5 - k) for r, k in zip(rows, rnd.integers(2, 6, 300).tolist())]
    rows = sorted(Counter(rows).items())
    expected = Counter()
    for r, n in rows:
        for k in range(2, 6):
            if r[k - 1]:
                expected[r[:k]] += n
    for size in (1, 7, 1000):
        monkeypatch.setattr(collocations, "MINED_ROWS", size)
        table = pa.table({"lang": ["en"] * len(rows)} | {f"w{i + 1}": pa.array([r[i] for r, _ in rows], pa.int64()) for i in range(5)} | {"n": pa.array([n for _, n in rows], pa.int64())})
        got = Counter()
        for batch in collocations._mine(5, 12, iter(table.to_batches(max_chunksize=3))):
            for w, n in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist()):
                got[tuple(w)] += n
        assert {w: n for w, n in got.items() if n >= 12} == {w: n for w, n in expected.items() if n >= 12}
