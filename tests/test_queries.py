"""Every query against its SQL on the smallest tables."""

import pytest

from quarry.queries import all_queries
from tests.compare import assert_equal

SF = "/root/testdata/sf0.001"
FOUND = all_queries()


@pytest.mark.parametrize("name", [n for n, (_, sql) in FOUND.items() if sql])
def test_equals_sql(spark, name):
    query, sql = FOUND[name]
    assert_equal(query(spark, SF), sql, SF)


@pytest.mark.parametrize("name", ["rank_dedup", "multi_query_search", "search_response"])
def test_scores_equal_sql_on_more_rows(spark, name):
    """Here some scores lie half-way between two numbers of six places."""
    query, sql = FOUND[name]
    more = SF.replace("sf0.001", "sf0.01")
    assert_equal(query(spark, more), sql, more)


@pytest.mark.parametrize("name", ["chunk_sentence", "chunk_semantic"])
def test_chunks_cover_texts(spark, name):
    got = FOUND[name][0](spark, SF).toPandas()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False, name=None))
    for doc_id, chunks in got.groupby("doc_id"):
        chunks = chunks.sort_values("chunk_index")
        assert list(chunks.chunk_index) == list(range(len(chunks)))
        text, upto = texts[doc_id], 0
        for c in chunks.itertuples():
            assert text[c.start_index : c.end_index] == c.text
            assert c.start_index <= upto
            upto = c.end_index
        assert upto == len(text)
    assert set(got.doc_id) == set(texts)


def test_entry_and_names():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(FOUND) <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
