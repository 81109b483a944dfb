import hashlib
import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import assemble, chunking, embedding, markdown, metadata, reports, search, text

SAMPLE = """# Sample Markdown File

Some **text**.

## Features

- [Links](https://example.com)

## Code

```python
def hello():
    pass
```
"""


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).first().x


def test_markdown_sample(spark):
    got = one(spark, SAMPLE, markdown.headings(F.col("t")))
    assert [tuple(h) for h in got] == [(1, "Sample Markdown File", "sample-markdown-file"), (2, "Features", "features"), (2, "Code", "code")]
    assert [tuple(x) for x in one(spark, SAMPLE, markdown.links(F.col("t")))] == [("Links", "https://example.com")]
    assert one(spark, SAMPLE, markdown.images(F.col("t"))) == []
    assert [b.language for b in one(spark, SAMPLE, markdown.code_blocks(F.col("t")))] == ["python"]
    assert one(spark, SAMPLE, markdown.tables(F.col("t"))) == []


def test_tables(spark):
    got = one(spark, "a | b | c\n-|-\n| 1 | 2 |\n\n|x|\n", markdown.tables(F.col("t")))
    assert got[0].headers == ["b"] and got[0].rows == [["1", "2"]] and got[0].row_count == 1
    assert got[1].headers == [] and got[1].column_count == 0 and got[1].row_count is None


def test_html(spark):
    assert one(spark, " <p>a &amp;lt; b</p>\n \n\n<script>x</script> ", text.html_to_text(F.col("t"))) == "a &lt; b\n\nx"


@pytest.mark.parametrize("value", ["", "a", "a\n", "\n", "a\x0bb\x1cc\x85d", "a\r\n\r\nb\r", "x ", "    \x1f"])
def test_profile_is_pythons(spark, value):
    row = text.text_profile(spark.createDataFrame([(value,)], "text string")).first()
    lines = value.splitlines()
    assert row.total_lines == len(lines)
    assert row.non_empty_lines == sum(bool(x.strip()) for x in lines)
    assert row.words == len(value.split())
    assert row.paragraphs == sum(bool(x.strip()) for x in value.split("\n\n"))


def test_binary(spark):
    bom, binary = text.binary_flags(F.col("t"))
    for value, expected in (("", False), ("a\0", True), ("ab\x01", True), ("abc\x01", False), ("a \n\t\x1c", False)):
        assert one(spark, value, binary) == expected, repr(value)
    assert one(spark, "﻿a", bom)


def test_frontmatter(spark):
    got = one(spark, {"a": ["1"], "b": ["1", "2"], "c": []}, text.flatten_frontmatter(F.col("t")), "map<string,array<string>>")
    assert got == {"a": "1", "b": '["1","2"]', "c": "[]"}


def test_pages_with_errors(spark):
    rows = spark.createDataFrame([(1, 2, "b ", None), (1, 1, " ", None), (1, 3, "x", "bad")], "d int, n int, t string, e string")
    got = assemble.assemble_pages(rows, "d", "n", "t", "e").first()
    assert got.content == "[Page 2]\nb\n\n[Page 3 - Error extracting text: bad]" and got.total_pages == 3


def test_fallback_fixtures():
    f = lambda *a: [(s, e, t) for s, e, t in chunking.fallback_windows(*a)]
    assert f("This is a test text for fallback chunking method testing", 20, 5) == [
        (0, 19, "This is a test text"), (19, 32, "for fallback"), (34, 48, "hunking method"), (49, 56, "testing"),
    ]
    assert f("This is a test text", 15, 3) == [(0, 14, "This is a test"), (14, 19, "text")]
    assert f("Test text", 20, 5) == [(0, 9, "Test text")]
    assert f("This is a test text for fallback chunking", 10, 2) == [
        (0, 9, "This is a"), (9, 14, "test"), (17, 23, "xt for"), (25, 32, "allback"), (33, 41, "chunking"),
    ]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n", min_size=1, max_size=200), st.integers(1, 40), st.data())
def test_sentence_windows_cover(value, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    upto = 0
    for start, end, piece in chunking.sentence_windows(value, size, overlap):
        assert value[start:end] == piece and start <= upto < end
        assert end - start <= size or piece in chunking.sentences(value)
        upto = end
    assert upto == len(value)


def test_no_sentence_chunk_lies_in_the_one_before():
    value = "One two. Abc. Defghi. A long sentence here. x."
    got = [(a, b) for a, b, _ in chunking.sentence_windows(value, 15, 10)]
    assert got == [(0, 14), (9, 22), (22, 44), (44, 46)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \u00a0\n", max_size=120), st.integers(1, 30), st.data())
def test_token_and_word_windows(value, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = list(chunking.token_windows(value, size, overlap))
    assert all(value[a:b] == t and len(t) <= size for a, b, t in got) and got[-1][1] == len(value)
    assert [a for a, _, _ in got] == [i * (size - overlap) for i in range(len(got))] and all(b < len(value) for _, b, _ in got[:-1])
    if value.strip():
        words = list(chunking.word_windows(value, size, overlap))
        assert words[0][0] == 0 and words[-1][1] == len(value) and all(len(t.split()) <= size for _, _, t in words)


@pytest.mark.parametrize("size,overlap", [(7, 2), (7, 5), (5, 0), (4, 2)])
def test_token_chunks_are_windows(spark, size, overlap):
    texts = ["", "   ", None, "a", "abcd", "abcdefg", "abcdefgh", "x\u00e9\U0001f600\n" * 9]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "k int, content string, text string")
    got = sorted((r.k, r.chunk_index, r.start_index, r.end_index, r.content, r.chunk_size, r.total_chunks, r.text) for r in chunking.chunk_token(docs, "content", size, overlap).collect())
    expected = []
    for i, t in enumerate(texts):
        windows = list(chunking.token_windows(t, size, overlap)) if t and t.strip() else []
        expected += [(i, j, a, b, p, b - a, len(windows), "c") for j, (a, b, p) in enumerate(windows)]
    assert got == expected


@pytest.mark.parametrize("chunk", [chunking.chunk_token, chunking.chunk_word, chunking.chunk_sentence])
def test_chunking_is_linear(spark, chunk):
    def took(mb):
        docs = spark.range(0, 1, 1, 1).select(F.repeat(F.lit("Some words of a text. And more: "), mb << 15).alias("text"))
        began = time.monotonic()
        docs.transform(chunk).agg(F.sum("chunk_size")).collect()
        return time.monotonic() - began

    took(1)
    small = min(took(1) for _ in range(2))
    assert took(8) < 16 * small + 5


def test_plain_markdown(spark):
    value = "# T\n> q *i* **b** `c`\n- item [l](u) ![a](i)\n```py\nx = 1\n```\nend"
    assert one(spark, value, markdown.plain(F.col("t"))) == "T\nq i b c\nitem l \nx = 1\nend"


@pytest.mark.parametrize("value", ["", "no front", "---\nkey without colon\n---\nx", "---\na: 1\n"])
def test_no_front_matter(spark, value):
    head, body = markdown.front_matter(F.col("t"))
    assert one(spark, value, head) == {}
    assert one(spark, value, body) == ("x" if value.endswith("x") else value)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(1, 40), st.data())
def test_lossless_fallback(value, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = "".join(t for _, _, t in chunking.fallback_windows(value, size, overlap, lossless=True))
    assert "".join(got.split()) == "".join(value.split())


@pytest.mark.parametrize("kind", ["token", "word", "sentence", "fallback", "unknown"])
def test_blank_texts_have_no_chunks(spark, kind):
    docs = spark.createDataFrame([(1, ""), (2, "   \n\t  "), (3, None), (4, "some text")], "k int, text string")
    got = chunking.chunk_documents(docs, "k", chunker_type=kind).collect()
    assert [(r.document_index, r.text) for r in got] == [(3, "some text")]


def test_optimize_fixture(spark):
    rows = [("x" * 44, 44), ("short", 5), ("        ", 8), ("y" * 43, 43)]
    got = chunking.optimize_chunks(spark.createDataFrame(rows, "text string, chunk_size int"), 100).collect()
    assert sorted(r.chunk_size for r in got) == [43, 44] and all(r.metadata["optimized"] == "true" for r in got)
    padded = "  \n  This text has whitespace  \t\n  "
    got = chunking.optimize_chunks(spark.createDataFrame([(padded, len(padded))], "text string, chunk_size int"), 50).first()
    assert (got.text, got.chunk_size) == ("This text has whitespace", 24)


def test_stats_fixture(spark):
    got = chunking.chunk_stats(spark.createDataFrame([(50,), (75,), (100,)], "chunk_size int"), 100, 10).first()
    assert tuple(got)[:5] == (3, 225, 75.0, 50, 100) and (got.chunk_size_setting, got.chunk_overlap) == (100, 10)
    empty = chunking.chunk_stats(spark.createDataFrame([], "chunk_size int")).first()
    assert empty.total_chunks == 0 and all(v is None for v in tuple(empty)[1:])


def test_index_is_dense_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 100003).alias("k")).repartition(7)
    got = sorted((r.k, r.i) for r in chunking.with_index(rows, "k", "i").collect())
    assert [i for _, i in got] == list(range(1000))


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_index_of_repeated_and_null_keys(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        rows = [(i % 3 if i % 5 else None, f"text {i % 50}") for i in range(400)]
        df = spark.createDataFrame(rows, "k int, text string")
        got = sorted((r.i, r.k is not None, r.k, r.text) for r in chunking.with_index(df, "k", "i").collect())
        assert [g[0] for g in got] == list(range(400)) and sorted((g[2] or -1, g[3]) for g in got) == sorted((k or -1, t) for k, t in rows)
        assert [g[1:3] for g in got] == sorted((g[1:3] for g in got), key=lambda x: (x[0], x[1] or 0))
        again = sorted((r.i, r.text) for r in chunking.with_index(df.repartition(9), "k", "i").collect())
        assert again == [(g[0], g[3]) for g in got]
        big = chunking.with_index(spark.range(300_000).select((F.col("id") % 1000).alias("k")).repartition(11), "k", "i")
        assert big.count() == 300_000 and big.select("i").distinct().count() == 300_000
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_documents_of_equal_keys_are_numbered_apart(spark):
    df = spark.createDataFrame([("a", "one"), ("a", "two"), ("a", "three"), ("b", "four")], "place string, text string")
    got = sorted((r.document_index, r.text) for r in chunking.chunk_documents(df, "place").collect())
    assert [i for i, _ in got] == [0, 1, 2, 3] and got[3] == (3, "four") and {t for _, t in got} == {"one", "two", "three", "four"}


def test_semantic_chunks_of_repeated_and_null_ids(spark):
    encode = lambda df, text: embedding.embed_chunks(df, text=text)
    rows = [(1, "One two. Three four."), (1, "Five six. Seven eight."), (None, "Nine ten. Nine ten."), (None, "Other words. Quite other.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = chunking.chunk_semantic(df, encode).collect()
    for doc_id, text in rows:
        mine = sorted((r.start_index, r.text) for r in got if r.doc_id == doc_id and r.text in text)
        assert "".join(t for _, t in mine) == text
    assert sum(r.total_chunks == 1 for r in got) == 1 and sorted(r.chunk_index for r in got) == [0, 0, 0, 0, 1, 1, 1]


def test_semantic_chunks_are_made_where_their_document_is_read(spark):
    """No vector is shuffled, and documents over several batches, or encoders that move rows, give the same chunks."""
    encode = lambda df, text: embedding.embed_chunks(df, text=text)
    rows = [(i, " ".join(f"w{(i * 7 + j) % 5} and w{j % (3 + i % 4)}." for j in range(1 + 37 * (i % 4)))) for i in range(12)] + [(50, None), (51, " \n"), (52, "x"), (53, "!? . \n Y. ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = chunking.chunk_semantic(df, encode, size=60)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    places = ["doc_id", "chunk_index", "total_chunks", "chunk_size", "start_index", "end_index", "text"]
    got = sorted(map(tuple, out.select(*places).collect()))
    moved = chunking.chunk_semantic(df, lambda d, t: encode(d, t).repartition(5, "pos"), size=60, keeps_order=False)
    assert sorted(map(tuple, moved.select(*places).collect())) == got
    with pytest.raises(Exception, match="keeps_order"):
        chunking.chunk_semantic(df, lambda d, t: encode(d, t).repartition(5, "pos"), size=60).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, chunking.chunk_semantic(df, encode, size=60).select(*places).collect())) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected, model = [], embedding.HashEncoder()
    for i, text in rows:
        parts: list = []
        for s in chunking.sentences(text) if text and text.strip() else []:
            v = model([s])[0] if s.strip() else None
            start = parts[-1][1] if parts else 0
            unlike = bool(parts) and v is not None and parts[-1][3] is not None and round(float(v @ parts[-1][3]), 9) < 0.2
            base = start if unlike or not parts else parts[-1][4]
            parts.append((start, start + len(s), unlike, v, base, (start + len(s) - 1 - base) // 60))
        firsts = [n for n, p in enumerate(parts) if n == 0 or p[2] or p[5] != parts[n - 1][5]]
        for nth, (a, b) in enumerate(zip(firsts, [*firsts[1:], len(parts)])):
            start, end = parts[a][0], parts[b - 1][1]
            expected.append((i, nth, len(firsts), end - start, start, end, text[start:end]))
    assert got == sorted(expected)


def test_pooling_merges_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(1e8, 1, d)]) for k, d in [("hot", 768)] * 300 + [("a", 3), ("a", 5), (None, 2), (None, 2)]]
    rows += [("gap", [1.0, None]), ("gap", [3.0, None]), ("none", None), ("empty", [])]
    df = spark.createDataFrame(rows, "k string, embedding array<double>").repartition(6)
    pooled = embedding.mean_pool(df, "k")
    got = {r.k: r.embedding for r in pooled.collect()}
    assert set(got) == {"hot", "a", None, "gap"} and len(got["a"]) == 5 and got["gap"] == [2.0]
    hot = np.array([v for k, v in rows if k == "hot"])
    assert np.allclose(got["hot"], hot.mean(axis=0), rtol=1e-15, atol=1e-6)
    stats = {r.k: (r["mean"], r["std"]) for r in embedding.embedding_stats(df, "k").collect()}
    assert set(stats) == set(got) and np.isclose(stats["hot"][1], hot.std(), rtol=1e-6) and np.isclose(stats["gap"][1], 1.0)
    for plan in (pooled, embedding.embedding_stats(df, "k")):
        assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()
    parts = df.mapInArrow(lambda b: embedding._partial(embedding._Sums, ["k", "sums", "counts"], b), "k string, sums array<double>, counts array<long>")
    assert parts.count() <= 4 * 6
    assert embedding.mean_pool(df.limit(0), "k").count() == 0


def test_encoder_counts_words(spark):
    model = embedding.HashEncoder(8)
    got = model(["Ab ab c", "c", "x\u2003y"])
    expected = np.zeros((3, 8))
    for i, words in enumerate((["ab", "ab", "c"], ["c"], ["x", "y"])):
        for w in words:
            expected[i, int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 8] += 1
    assert np.allclose(got, expected / np.linalg.norm(expected, axis=1, keepdims=True))
    df = spark.createDataFrame([(1, None), (2, " \t"), (3, "a b"), (4, "")], "id int, text string")
    assert {r.id: r.embedding is None for r in embedding.embed_chunks(df).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_normalize_fixture(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([1.0, 0.0],), ([0.0, 0.0],), ([],)], "v array<double>")
    got = [r.x for r in rows.select(embedding.l2_normalize(F.col("v")).alias("x")).collect()]
    assert np.allclose(got[0], [0.6, 0.8]) and got[1] == [1.0, 0.0] and got[2] == [0.0, 0.0] and got[3] == []


def test_encoder_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    def encoder(texts):
        sizes.add(1000 + len(texts))
        return np.array([[len(t)] for t in texts], dtype=float)

    rows = spark.createDataFrame([("a",), ("bb",), ("",), ("ccc",), ("\n\t",)], "text string").coalesce(1)
    got = [r.embedding for r in embedding.embed_chunks(rows, encoder, batch_size=2).collect()]
    assert got == [[1.0], [2.0], None, [3.0], None]
    assert sizes.value == 2003


def test_width_error(spark):
    rows = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>")
    with pytest.raises(Exception, match="several widths"):
        embedding.embedding_dim(rows).collect()


def test_sanitize(spark):
    rows = spark.sql("SELECT 1 AS i, 'a' AS s, array(1, 2) AS l, map('k', 1) AS m, date'2024-01-01' AS d, CAST(NULL AS array<int>) AS n")
    got = metadata.sanitize_metadata(rows).first().asDict()
    assert got == {"i": 1, "s": "a", "l_json": "[1,2]", "l_count": 2, "m_json": '{"k":1}', "d_str": "2024-01-01", "n_json": None, "n_count": None}


def test_front_matter_wins(spark):
    rows = spark.createDataFrame([("/a.md", "# t", 3, {"file_type": "own"})], "p string, t string, s int, m map<string,string>")
    got = metadata.document_metadata(rows, "p", "t", "s", own="m").first().metadata
    assert got["file_type"] == "own" and got["headings_count"] == "1"


@pytest.mark.parametrize("query,expected", [("plain", 1.0), ("stop", 1.2), ("show", 1.1), ("machine learning", 1.15), ("a b c d e f g h i", 0.9), ("how to learn best", 1.45)])
def test_importance(spark, query, expected):
    assert math.isclose(one(spark, query, search.query_importance(F.col("t"))), expected)


def test_parse_variations(spark):
    rows = spark.createDataFrame([(1, "1. a\nno\n2) b\n3. c.d\n4."), (2, ""), (3, None)], "i int, answer string")
    got = {r.i: r.queries for r in search.parse_variations(rows).collect()}
    assert got[1] == ["a", "c.d", "a", "a", "a", "a"] and got[2] == got[3] == ["search query"] * 6


HITS = "user_query string, query string, query_index int, result_index int, document string, filename string, filepath string, chunk_index int, distance double"


def test_rank_dedup(spark):
    rows = [
        ("q", "q", 1, 0, "d1", "a.txt", "/x/a.txt", 0, 0.5),
        ("q", "best q", 4, 0, "d2", "a.txt", "/y/a.txt", 0, 0.5),
        ("q", "q", 1, 1, "d3", "b.txt", "/x/b.txt", 1, 1.5),
        ("q", "q", 1, 2, "d4", None, None, None, None),
        ("q", "how to q", 3, 0, "d5", "c.txt", "/c.txt", 0, 0.4),
    ]
    df = spark.createDataFrame(rows, HITS)
    got = search.rank_dedup(df.repartition(3)).orderBy("rank").collect()
    assert [r.document for r in got] == ["d5", "d1", "d4", "d3"]
    assert got[1].found_by_queries == ["q", "best q"] and got[1].total_matches == 2 and got[1].importance == 1.0
    assert got[3].weighted_score == -0.5 and got[2].filename == "unknown" and got[2].base_score == 0.0
    assert [r.document for r in search.rank_dedup(df, 1).collect()] == ["d5"]
    by_path = search.rank_dedup(df, key="filepath")
    assert by_path.count() == 5


def test_metrics_bounds(spark):
    ranked = spark.createDataFrame([("q", 0.4, "a", ["x"]), ("q", 0.7, "a", ["x", "y"]), ("q", 0.71, "b", ["x"]), ("q", 0.39, "c", ["x"])], "user_query string, weighted_score double, filename string, found_by_queries array<string>")
    asked = spark.createDataFrame([("q",), ("none",)], "user_query string")
    got = {r.user_query: r for r in search.quality_metrics(ranked, asked).collect()}
    assert (got["q"].high_quality, got["q"].medium_quality, got["q"].low_quality) == (1, 2, 1)
    assert got["q"].diversity == 0.75 and math.isclose(got["q"].coverage, 2 / 6)
    assert got["none"].no_results and got["none"].coverage == 0


@pytest.mark.parametrize("n,k", [(0, 3), (2, 5), (300, 7)])
def test_knn_equals_expressions(spark, n, k):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(n)] + [(10**6, None), (10**6 + 1, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(6)], "query_id int, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.id, r.distance) for r in search.knn_search(df, queries, k).collect())
    expected = []
    for q in queries.collect():
        near = sorted((sum((a - b) ** 2 for a, b in zip(q.embedding, v)), i) for i, v in rows if v is not None and len(v) == 3)[:k]
        expected += [(q.query_id, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert got == sorted(expected)


def test_knn_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(50)], "id long, embedding array<double>")
    whole = sorted(map(tuple, search.knn_search(df, df.withColumnRenamed("id", "query_id"), 3).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "ROW_BLOCK", 4)
    assert sorted(map(tuple, search.knn_search(df, df.withColumnRenamed("id", "query_id"), 3).collect())) == whole


def test_knn_of_many_queries_sends_out_few_rows(spark):
    """A part's rows for a block of queries leave the task once, and no block is broadcast beside others."""
    n, k = 50_000, 3
    point = lambda *c: F.array(*[(F.sin(F.col("id") * x) * 100).alias("x") for x in c])
    rows = spark.range(3000).select("id", point(0.7, 1.3, 2.1).alias("embedding"))
    queries = spark.range(n).select(F.col("id").alias("query_id"), point(0.2, 3.3, 1.7).alias("embedding"))
    near = search.nearest_by_part(rows, queries, k, "id", "query_id", "embedding", part_bytes=40_000)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    found = near.toPandas()
    assert n * k <= len(found) <= 2 * n * k
    best = found.sort_values(["__q", "distance", "id"]).groupby("__q").head(k)
    x, q = (np.array(d.orderBy(c).toPandas().embedding.tolist()) for d, c in ((rows, "id"), (queries.filter("query_id < 300"), "query_id")))
    exact = np.argsort(((q[:, None] - x[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :k]
    assert [sorted(g) for _, g in best[best["__q"] < 300].groupby("__q").id] == [sorted(r) for r in exact.tolist()]


def test_knn_of_a_vector_that_a_third_of_rows_have(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id") * 1.0, F.lit(0.0))).alias("embedding"))
    queries = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "query_id int, embedding array<double>")
    near = search.nearest_by_part(rows, queries, 4, "id", "query_id", "embedding")
    assert near.count() <= 3 * 4 * rows.rdd.getNumPartitions()
    got = search.knn_search(rows, queries, 4).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(q, i) for q in range(3) for i in (0, 3, 6, 9)]


def test_search_reads_a_stored_collection(spark):
    from quarry.queries import search as queries

    for name in ("multi_query_search", "rank_dedup", "search_counters", "quality_metrics", "search_response"):
        plan = queries.QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "encode(" not in plan, name


def test_human_size(spark):
    for n, expected in ((0, "0 B"), (1024, "1024 B"), (1025, "1.0 KB"), (1048576, "1024.0 KB"), (1572864, "1.5 MB")):
        assert one(spark, n, reports.human_size(F.col("t")), "long") == expected


def test_human_size_rounds_halves_as_its_sql(spark):
    cases = ((1280, "1.2 KB"), (1792, "1.8 KB"), (2304, "2.2 KB"), (1024 * 1024 * 5 // 4, "1.2 MB"), (2359296, "2.2 MB"), (None, None))
    for n, expected in cases:
        assert one(spark, n, reports.human_size(F.col("t")), "long") == expected, n


def test_empty_system_stats(spark):
    none = spark.createDataFrame([], "filepath string")
    jobs = spark.createDataFrame([], "status string, completed_at timestamp")
    got = reports.system_stats(none, jobs, spark.createDataFrame([], "length long")).first()
    assert tuple(got) == (0, 1, 0, "Never", "0 B")


def test_document_metadata_looks_at_a_text_once(spark):
    from quarry.operators import metadata
    from quarry.queries import vectors

    plan = vectors.document_metadata(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\p{Zl}") == 1 and plan.count("lower(text") == 1
    rows = [(1, "a.txt", "One\n \n\x1c\x85Tödo\r\n\u2028x"), (2, "b.md", "# H"), (3, "c.txt", None), (4, "d.txt", "\x01\x02a"), (5, "e.txt", " \n\t")]
    out = metadata.document_metadata(spark.createDataFrame(rows, "id int, p string, t string").withColumn("n", F.lit(1)), path="p", text="t", size="n")
    got = {r["id"]: r["metadata"] for r in out.collect()}
    assert out.columns == ["id", "p", "t", "n", "metadata"]
    assert [got[1][k] for k in ("total_lines", "non_empty_lines", "whitespace_lines", "is_binary", "file_type_hints")] == ["7", "3", "4", "false", "[]"]
    assert set(got[2]) == {"file_path", "file_type", "file_size", "content_length", "headings_count", "links_count", "images_count", "code_blocks_count", "tables_count"}
    assert (got[3]["is_binary"], got[3]["non_empty_lines"], got[4]["is_binary"], got[5]["non_empty_lines"]) == (None, "0", "true", "0")


def test_chunk_token_leaves_the_text_below_the_explosion(spark):
    from quarry.operators import chunking

    docs = spark.createDataFrame([(1, "ab" * 700, "x")], "id int, text string, more string")
    out = chunking.chunk_token(docs)
    above = out._jdf.queryExecution().optimizedPlan().toString().partition("Generate")[0].lower()
    assert "ceil" not in above and "regexp" not in above
    assert [(r["chunk_index"], r["start_index"], r["end_index"], r["total_chunks"], r["more"]) for r in out.orderBy("chunk_index").collect()] == [
        (0, 0, 512, 3, "x"), (1, 462, 974, 3, "x"), (2, 924, 1400, 3, "x")
    ]


def test_texts_are_encoded_in_bounded_bytes(spark):
    import numpy as np

    from quarry.operators import embedding

    class Bounded:
        batch_size = 1000

        def __call__(self, texts):
            assert sum(map(len, texts)) <= 6 << 20
            return np.array([[len(t)] for t in texts])

    rows = spark.range(0, 24, numPartitions=1).select("id", F.repeat(F.lit("x"), F.when(F.col("id") % 5 > 0, F.lit(1 << 20) + F.col("id")).otherwise(0).cast("int")).alias("text"))
    got = {r["id"]: r["v"] for r in embedding.embed_chunks(rows, Bounded()).select("id", F.get("embedding", F.lit(0)).alias("v")).collect()}
    assert got == {i: float((1 << 20) + i) if i % 5 else None for i in range(24)}
