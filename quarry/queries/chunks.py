"""Chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, embedding
from quarry.queries import frames as fr
from quarry.queries.frames import embed_sql, strip_sql

SIZE, OVERLAP = chunking.CHUNK_SIZE, chunking.OVERLAP
STRIDE = SIZE - OVERLAP
_COLUMNS = ["doc_id", "chunk_index", "total_chunks", "chunk_size", "start_index", "end_index", "text"]


def chunk_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_token(fr.table(spark, sf_dir, "documents")).select(*_COLUMNS)


def token_sql(source: str, columns: str = "doc_id") -> str:
    """Rows of ``columns`` and the chunk's own columns."""
    return f"""(SELECT {columns}, ((s // {STRIDE}))::INT AS chunk_index, n::INT AS total_chunks, (least(s + {SIZE}, length(text)) - s)::INT AS chunk_size,
  s::INT AS start_index, least(s + {SIZE}, length(text))::INT AS end_index, text[s + 1:s + {SIZE}] AS text
  FROM (SELECT *, unnest(range(0, n * {STRIDE}, {STRIDE})) AS s FROM (SELECT *, greatest(1, ceil((length(text) - {OVERLAP}) / {STRIDE}))::INT AS n
    FROM {source} WHERE {strip_sql('text')} <> '')))"""


TOKEN = f"SELECT * FROM {token_sql('documents')}"


def chunk_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_word(fr.table(spark, sf_dir, "documents"), size=100, overlap=20).select(*_COLUMNS)


WORD = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '(?:\A{fr.WS}+)?[^\t\n\x0b\f\r\x1c-\x20\x{{85}}\x{{a0}}\p{{Z}}]+{fr.WS}*') AS ws FROM documents),
n AS (SELECT *, greatest(1, ceil((len(ws) - 20) / 80))::INT AS n FROM w WHERE len(ws) > 0),
s AS (SELECT *, unnest(range(0, n)) AS i FROM n),
t AS (SELECT doc_id, i, n, array_to_string(ws[i * 80 + 1:i * 80 + 100], '') AS text, length(array_to_string(ws[1:i * 80], '')) AS b FROM s)
SELECT doc_id, i::INT AS chunk_index, n AS total_chunks, length(text)::INT AS chunk_size, b::INT AS start_index, (b + length(text))::INT AS end_index, text FROM t"""


def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_sentence(fr.table(spark, sf_dir, "documents")).select(*_COLUMNS)


#: Sentences with their places; a sign that no text has marks their ends.
_SENTENCES = rf"""SELECT doc_id, text, p, a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY p), length(text)) AS b FROM (
  SELECT doc_id, text, p, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (
    SELECT doc_id, text, unnest(l) AS s, generate_subscripts(l, 1) AS p FROM (
      SELECT doc_id, text, string_split(regexp_replace(text, '([.!?]{fr.WS}+)', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents WHERE {strip_sql('text')} <> '')) WHERE s <> '')"""
#: A chunk's sentences end at the last place within ``size``; the next one's begin where overlap and the sentence behind both fit.
SENTENCE = f"""WITH RECURSIVE sentences AS ({_SENTENCES}),
places AS (SELECT doc_id, any_value(text) AS text, list(a ORDER BY p) || [length(any_value(text))] AS stops FROM sentences GROUP BY doc_id),
step AS (
  SELECT doc_id, 0 AS k, 1 AS i, greatest(2, len(list_filter(stops, lambda v: v <= {SIZE}))) AS j FROM places
  UNION ALL
  SELECT doc_id, k + 1, n, greatest(n + 1, len(list_filter(stops, lambda v: v <= stops[n] + {SIZE}))) FROM (
    SELECT doc_id, k, stops, least(j, greatest(i + 1, 1 + len(list_filter(stops, lambda v: v < greatest(stops[j] - {OVERLAP}, stops[j + 1] - {SIZE}))))) AS n
    FROM step JOIN places USING (doc_id) WHERE j < len(stops)))
SELECT doc_id, k::INT AS chunk_index, count(*) OVER (PARTITION BY doc_id)::INT AS total_chunks, (stops[j] - stops[i])::INT AS chunk_size, stops[i]::INT AS start_index, stops[j]::INT AS end_index,
  text[stops[i] + 1:stops[j]] AS text FROM step JOIN places USING (doc_id)"""


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = lambda df, text: embedding.embed_chunks(df, text=text)
    return chunking.chunk_semantic(fr.table(spark, sf_dir, "documents"), encode).select(*_COLUMNS)


SEMANTIC = f"""WITH sentences AS ({_SENTENCES}), s AS (SELECT doc_id, p, a, b, doc_id || '/' || p AS id, text[a + 1:b] AS sentence FROM sentences), e AS {embed_sql('s', 'id', 'sentence')},
v AS (SELECT s.*, embedding, lag(embedding) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM s LEFT JOIN e USING (id)),
u AS (SELECT *, coalesce(round(list_sum(list_transform(list_zip(embedding, last), lambda x: x[1] * x[2])), 9) < 0.2, false)::INT AS unlike FROM v),
g AS (SELECT *, sum(unlike) OVER (PARTITION BY doc_id ORDER BY p) AS part FROM u),
h AS (SELECT *, (b - 1 - min(a) OVER (PARTITION BY doc_id, part)) // {SIZE} AS sub FROM g),
c AS (SELECT doc_id, string_agg(sentence, '' ORDER BY p) AS text, min(a) AS a, max(b) AS b FROM h GROUP BY doc_id, part, sub)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS chunk_index, count(*) OVER (PARTITION BY doc_id)::INT AS total_chunks, length(text)::INT AS chunk_size,
  a::INT AS start_index, b::INT AS end_index, text FROM c"""


def chunk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_fallback(fr.table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "chunk_size", "start_index", "end_index", "text")


_LAST_SPACE = f"{SIZE} - instr(reverse(text[s + 1:s + {SIZE}]), ' ')"
FALLBACK = f"""WITH RECURSIVE step AS (
  SELECT doc_id, text, 0 AS s, CASE WHEN length(text) > {SIZE} AND contains(text[2:{SIZE}], ' ') THEN {SIZE} - instr(reverse(text[1:{SIZE}]), ' ') ELSE least({SIZE}, length(text)) END AS e
  FROM documents WHERE {strip_sql('text')} <> ''
  UNION ALL
  SELECT doc_id, text, s, CASE WHEN s + {SIZE} < length(text) AND contains(text[s + 2:s + {SIZE}], ' ') THEN s + {_LAST_SPACE} ELSE least(s + {SIZE}, length(text)) END
  FROM (SELECT doc_id, text, greatest(s + {STRIDE}, e) AS s FROM step) WHERE s < length(text)),
p AS (SELECT doc_id, s, e, {strip_sql('text[s + 1:e]')} AS text FROM step)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS chunk_index, length(text)::INT AS chunk_size, s::INT AS start_index, e::INT AS end_index, text
FROM p WHERE text <> ''"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fr.table(spark, sf_dir, "documents")
    return docs.select((F.lit(1000000000) - F.col("doc_id")).alias("place"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("given"), "text")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.chunk_documents(_documents(spark, sf_dir), "place", "given", chunker_type="TOKEN")
    return out.select("document_index", "document_id", "chunk_index", "chunk_size", "chunker_type")


DOCUMENTS = f"""SELECT document_index, document_id, chunk_index, chunk_size, 'token' AS chunker_type FROM {token_sql(
    "(SELECT text, row_number() OVER (ORDER BY 1000000000 - doc_id) - 1 AS document_index, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE md5((1000000000 - doc_id)::VARCHAR) END AS document_id FROM documents)",
    "document_index, document_id")}"""


def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_token(fr.table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "chunk_index", "total_chunks")


TOTALS = f"SELECT doc_id, chunk_index, total_chunks FROM {token_sql('documents')}"


def optimize_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_token(fr.table(spark, sf_dir, "documents"))
    out = chunking.optimize_chunks(chunks)
    return out.select("doc_id", "chunk_index", "chunk_size", "text", F.col("metadata")["optimized"].alias("optimized"))


OPTIMIZED = f"""SELECT doc_id, chunk_index, length(t)::INT AS chunk_size, t AS text, 'true' AS optimized
FROM (SELECT *, {strip_sql('text')} AS t FROM {token_sql('documents')} WHERE chunk_size >= {0.1 * SIZE}) WHERE t <> ''"""


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.chunk_stats(chunking.chunk_token(fr.table(spark, sf_dir, "documents")))
    return out.withColumn("average_chunk_size", F.round("average_chunk_size", 6))


STATS = f"""SELECT count(*) AS total_chunks, sum(chunk_size)::BIGINT AS total_characters, round(avg(chunk_size), 6) AS average_chunk_size, min(chunk_size) AS min_chunk_size,
  max(chunk_size) AS max_chunk_size, {SIZE} AS chunk_size_setting, {OVERLAP} AS chunk_overlap, 'token' AS chunker_type FROM {token_sql('documents')}"""

QUERIES = {
    "chunk_token": (chunk_token, TOKEN),
    "chunk_word": (chunk_word, WORD),
    "chunk_sentence": (chunk_sentence, SENTENCE),
    "chunk_semantic": (chunk_semantic, SEMANTIC),
    "chunk_fallback": (chunk_fallback, FALLBACK),
    "chunk_documents": (chunk_documents, DOCUMENTS),
    "chunk_totals": (chunk_totals, TOTALS),
    "optimize_chunks": (optimize_chunks, OPTIMIZED),
    "chunk_stats": (chunk_stats, STATS),
}
