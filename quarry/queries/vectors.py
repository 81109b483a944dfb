"""Embeddings and the metadata stored with chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, embedding, metadata
from quarry.queries import frames as fr
from quarry.queries.chunks import token_sql
from quarry.queries.frames import WS, embed_sql, strip_sql


def chunks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    docs = fr.documents(spark, sf_dir).select("doc_id", "filename", "filepath", "text", *more)
    return chunking.chunk_token(docs)


CHUNKS = token_sql(fr.DOCUMENTS, "doc_id, filename, filepath, source, lang")


def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding.embed_chunks(chunks(spark, sf_dir).select("doc_id", "chunk_index", "text"))
    digits = F.array_join(F.transform("embedding", lambda x: F.round(x * 1000000, 0).cast("long").cast("string")), ",")
    return out.select("doc_id", "chunk_index", digits.alias("millionths"))


EMBEDDED = f"""WITH c AS (SELECT doc_id, chunk_index, doc_id || '/' || chunk_index AS id, text FROM {CHUNKS}), e AS {embed_sql('c', 'id', 'text')}
SELECT doc_id, chunk_index, array_to_string(list_transform(embedding, lambda x: round(x * 1000000, 0)::BIGINT), ',') AS millionths FROM c LEFT JOIN e USING (id)"""


def _some_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and behind them some that are blank or null."""
    docs = fr.documents(spark, sf_dir).select("doc_id", "source", "text")
    blank = docs.filter("doc_id % 11 = 0").withColumns({"doc_id": F.col("doc_id") + 1000000000, "text": F.lit(" \t")})
    null = docs.filter("doc_id % 13 = 0").withColumns({"doc_id": F.col("doc_id") + 2000000000, "text": F.lit(None).cast("string")})
    return docs.unionByName(blank).unionByName(null)


_BLANKED = """(SELECT doc_id, source, text FROM documents UNION ALL SELECT doc_id + 1000000000, source, ' ' || chr(9) FROM documents WHERE doc_id % 11 = 0
  UNION ALL SELECT doc_id + 2000000000, source, NULL FROM documents WHERE doc_id % 13 = 0)"""


def valid_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.valid_texts(_some_blank(spark, sf_dir))


VALID = f"SELECT * FROM {_BLANKED} WHERE {strip_sql('text')} <> ''"


def embedding_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embedding_mismatch(embedding.embed_chunks(_some_blank(spark, sf_dir)), "source")


MISMATCH = f"""SELECT source, 'Embedding count mismatch: ' || n || ' chunks, ' || m || ' embeddings' AS error
FROM (SELECT source, count(*) AS n, count(*) FILTER ({strip_sql('text')} <> '') AS m FROM {_BLANKED} GROUP BY source) WHERE n <> m"""


def _joined(v: str):
    return F.array_join(F.transform(v, lambda x: F.round(x * 1000000, 0).cast("long").cast("string")), ",")


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding.mean_pool(fr.table(spark, sf_dir, "embeddings"), "label")
    return out.select("label", F.posexplode("embedding").alias("at", "x")).select("label", "at", F.round("x", 6).alias("x"))


POOLED = """SELECT label, (place - 1)::INT AS at, round(avg(x), 6) AS x FROM
(SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY ALL"""


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5))
    out = fr.table(spark, sf_dir, "embeddings").select("vec_id", embedding.l2_normalize(scaled).alias("v"))
    return out.select("vec_id", F.posexplode("v").alias("at", "x")).select("vec_id", "at", F.round("x", 6).alias("x"))


NORMALIZED = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM v)
SELECT vec_id, (place - 1)::INT AS at, round(x, 6) AS x FROM (SELECT vec_id, unnest(list_transform(v, lambda x: x / CASE WHEN l = 0 THEN 1 ELSE l END)) AS x, generate_subscripts(v, 1) AS place FROM n)"""


def embedding_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embedding_dim(fr.table(spark, sf_dir, "embeddings"))


def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding.embedding_stats(fr.table(spark, sf_dir, "embeddings"), "label")
    return out.select("label", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


STATS = """SELECT label, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label"""


def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fr.documents(spark, sf_dir).withColumn("file_size", F.octet_length("text").cast("long"))
    out = metadata.document_metadata(docs, path="filepath", text="text", size="file_size")
    wanted = ("file_path", "file_type", "file_size", "content_length", "encoding", "words", "paragraphs", "line_endings", "has_bom", "is_binary")
    return out.select("doc_id", *[F.col("metadata")[k].alias(k) for k in wanted])


METADATA = f"""SELECT doc_id, filepath AS file_path, '.txt' AS file_type, strlen(text)::VARCHAR AS file_size, length(text)::VARCHAR AS content_length, 'utf-8' AS encoding,
  len(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> ''))::VARCHAR AS words,
  len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: {strip_sql('x')} <> ''))::VARCHAR AS paragraphs,
  CASE WHEN contains(text, chr(10)) THEN 'LF (Unix/Linux)' ELSE 'Unknown' END AS line_endings, 'false' AS has_bom, 'false' AS is_binary FROM {fr.DOCUMENTS}"""


def sanitize_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fr.table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", "ts", F.array("event_type", F.col("user_id").cast("string")).alias("tags"), F.struct("user_id").alias("user"), (F.col("user_id") > 5).alias("known")
    )
    out = metadata.sanitize_metadata(df, keep=("event_id",))
    return out.select("event_id", "event_type", "value", "ts_str", "tags_json", "tags_count", "user_json", "known")


SANITIZED = """SELECT event_id, event_type, value, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS ts_str,
  '["' || event_type || '","' || user_id || '"]' AS tags_json, 2 AS tags_count, '{"user_id":' || user_id || '}' AS user_json, user_id > 5 AS known FROM events"""


def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.create_map(F.lit("lang"), F.col("lang"), F.lit("filename"), F.when(F.col("doc_id") % 3 == 0, F.lit("own name")).otherwise(F.col("filename")))
    rows = chunks(spark, sf_dir, "lang").withColumn("document_metadata", document)
    out = metadata.chunk_metadata(rows)
    wanted = ("filename", "filepath", "chunk_index", "total_chunks", "chunk_content", "lang")
    return out.select("doc_id", F.col("chunk_index").alias("i"), *[F.col("metadata")[k].alias(k) for k in wanted])


CHUNK_METADATA = f"""SELECT doc_id, chunk_index AS i, CASE WHEN doc_id % 3 = 0 THEN 'own name' ELSE filename END AS filename, filepath, chunk_index::VARCHAR AS chunk_index,
  total_chunks::VARCHAR AS total_chunks, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS chunk_content, lang FROM {CHUNKS}"""


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.chunk_ids(chunks(spark, sf_dir)).select("doc_id", "chunk_index", "id")


IDS = f"""SELECT doc_id, chunk_index, filename || '_' || chunk_index || '_' || md5(filepath || chr(31) || chunk_index || chr(31) || text)[1:8] AS id FROM {CHUNKS}"""

QUERIES = {
    "embed_chunks": (embed_chunks, EMBEDDED),
    "valid_texts": (valid_texts, VALID),
    "embedding_mismatch": (embedding_mismatch, MISMATCH),
    "mean_pool": (mean_pool, POOLED),
    "l2_normalize": (l2_normalize, NORMALIZED),
    "embedding_dim": (embedding_dim, "SELECT DISTINCT len(embedding)::INT AS dim FROM embeddings"),
    "embedding_stats": (embedding_stats, STATS),
    "document_metadata": (document_metadata, METADATA),
    "sanitize_metadata": (sanitize_metadata, SANITIZED),
    "chunk_metadata": (chunk_metadata, CHUNK_METADATA),
    "chunk_ids": (chunk_ids, IDS),
}
