"""The pipeline's stages, each against brute force on what the stage before it kept."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import packing
from quarry.llm.common import stored
from tests.llm.test_dedup import brute_components, brute_repeats, brute_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(kept):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == kept[0].columns for df in kept[1:5])


def test_good_documents_stay(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = texts(kept[0]), texts(kept[1])
    good, bad = ([i for i in before if labels.get(i) == q] for q in (1, 0))
    assert sum(i in after for i in good) >= 0.95 * len(good) and sum(i in after for i in bad) <= 0.3 * len(bad)


def test_exact(kept):
    best: dict = {}
    for i, t in texts(kept[1]).items():
        best[t] = max(i, best.get(t, i))
    assert texts(kept[2]) == {i: t for t, i in best.items()}


def test_near(kept):
    docs = {i: (brute_simhash(t), t) for i, t in texts(kept[2]).items()}
    fps = sorted({f for f, _ in docs.values()})
    label = brute_components(fps, [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if bin(a ^ b).count("1") <= 4])
    first: dict = {}
    for i, (f, _) in docs.items():
        first[label[f]] = min(i, first.get(label[f], i))
    assert texts(kept[3]) == {i: docs[i][1] for i in first.values()}


def test_passages(kept):
    expected = brute_repeats(list(texts(kept[3]).items()), 100)
    assert texts(kept[4]) == {i: k.decode("utf-8", "ignore") for i, (_, _, _, k) in expected.items()}


def test_packing(kept):
    words = packing.WordTokenizer(packing.production_path())
    got = kept[5].collect()
    for i, t in texts(kept[4]).items():
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == [*words.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_run(spark, kept):
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in kept[5].collect())


def test_run_leaves_little_behind(spark, kept, tmp_path):
    """Of all tables that a run stores only those stay that its rows are read from; nulls, repeated ids and no rows at all are fine."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("stage", F.lit("clash"))
    odd = docs.limit(3).withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, rows in (("some", docs.unionByName(odd).unionByName(odd)), ("none", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    place = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(place))
    got = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert got.count() > 0 and len(set(os.listdir(place)) - before) <= 3
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
