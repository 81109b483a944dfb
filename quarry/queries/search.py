"""Search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import embedding, search
from quarry.queries import frames as fr
from quarry.queries import vectors
from quarry.queries.frames import WS, embed_sql, strip_sql
from quarry.queries.vectors import CHUNKS
from quarry.sources.collection import metadata_equals, open_collection, store_chunks
from quarry.sources.scratch import scratch_path, stored


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for each benchmark text, which it has as a whole; some name what raises importance."""
    q = F.concat(F.when(F.col("item_id") % 4 == 0, F.lit(" show ")).when(F.col("item_id") % 4 == 1, F.lit("Learn ")).otherwise(F.lit("")), F.col("text"))
    return fr.table(spark, sf_dir, "benchmark").select(q.alias("user_query"))


QUESTIONS = "(SELECT DISTINCT CASE item_id % 4 WHEN 0 THEN ' show ' WHEN 1 THEN 'Learn ' ELSE '' END || text AS user_query FROM benchmark)"


def query_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.query_variations(questions(spark, sf_dir).distinct()).select("user_query", "query_index", "query")


_Q = strip_sql("user_query")
VARIATIONS = f"""(SELECT user_query, i AS query_index, ([q, 'what is ' || q, 'how to ' || q, 'best ' || q, q || ' examples', q || ' tutorial'])[i] AS query
  FROM (SELECT user_query, {_Q} AS q, unnest(range(1, 7))::INT AS i FROM {QUESTIONS}))"""


def repeat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.repeat_query(questions(spark, sf_dir).distinct()).select("user_query", "query_index", "query")


REPEATED = f"SELECT user_query, unnest(range(1, 7))::INT AS query_index, user_query AS query FROM {QUESTIONS}"


def parse_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of a conversation's turns: numbered lines, with and without text behind the number; some have none."""
    t = fr.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit("\n 3. ")).alias("t"))
    answer = F.concat(F.lit("Sure:\n1. "), "t", F.lit("\n2.\n4) no\n x"), F.when(F.col("turn") % 2 == 0, F.lit("\n5.a.b ")).otherwise(F.lit("")))
    none = t.filter("turn = 3").select("conv_id", F.col("turn") + 100000, F.lit("none"))
    out = search.parse_variations(t.select("conv_id", "turn", answer.alias("answer")).union(none))
    return out.select("conv_id", "turn", F.array_join("queries", "¦").alias("queries"))


PARSED = f"""WITH a AS (SELECT conv_id, turn, 'Sure:' || chr(10) || '1. ' || replace(text, chr(10), chr(10) || ' 3. ') || chr(10) || '2.' || chr(10) || '4) no' || chr(10) || ' x'
    || CASE WHEN turn % 2 = 0 THEN chr(10) || '5.a.b ' ELSE '' END AS answer FROM conversations UNION ALL SELECT conv_id, turn + 100000, 'none' FROM conversations WHERE turn = 3),
l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(answer, chr(10)), lambda x: {strip_sql('x')}), lambda x: regexp_matches(x, '^\\p{{Nd}}') AND contains(x, '.')) AS l FROM a),
q AS (SELECT conv_id, turn, list_filter(list_transform(l, lambda x: {strip_sql("x[instr(x, '.') + 1:]")}), lambda x: x <> '') AS q FROM l)
SELECT conv_id, turn, array_to_string((q || list_transform(range(6), lambda i: coalesce(q[1], 'search query')))[1:6], '¦') AS queries FROM q"""


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn_search(fr.table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 10, "vec_id")


def knn_sql(collection: str, where: str = "true") -> str:
    return f"""SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM
  (SELECT q.vec_id AS query_id, c.vec_id, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS distance
   FROM {collection} c, embeddings q WHERE q.vec_id % 50 = 0 AND {where}) QUALIFY rank <= 10"""


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows of a collection among those with a label in their metadata, which is searched in the scan."""
    rows = fr.table(spark, sf_dir, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("embedding"), F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("vec_id"), F.col("vec_id").cast("string")).alias("metadata")
    )
    path = scratch_path(spark, "collection")
    open_collection(spark, path, promoted={"label": "int", "vec_id": "long"})
    store_chunks(rows, path)
    held = open_collection(spark, path).withColumn("vec_id", F.col("meta_vec_id"))
    return search.knn_search(held, _vector_queries(spark, sf_dir), 10, "vec_id", where=metadata_equals(held, {"label": 3}))


def query_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.query_variations(questions(spark, sf_dir).distinct())
    return rows.select("user_query", "query_index", F.round(search.query_importance(F.col("query")), 6).alias("importance"))


def importance_sql(q: str) -> str:
    groups = " + ".join(f"CASE WHEN regexp_matches(lower({q}), '{g}') THEN {more}::DOUBLE ELSE 0::DOUBLE END" for g, more in search.IMPORTANCE)
    many = f"CASE WHEN len(list_filter(string_split_regex({q}, '{WS}+'), lambda w: w <> '')) > 8 THEN 0.1::DOUBLE ELSE 0::DOUBLE END"
    return f"greatest(0.5::DOUBLE, least(1.5::DOUBLE, 1::DOUBLE + {groups} - {many}))"


IMPORTANCE = f"SELECT user_query, query_index, round({importance_sql('query')}, 6) AS importance FROM {VARIATIONS}"


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' chunks, stored with their vectors."""
    rows = embedding.embed_chunks(vectors.chunks(spark, sf_dir))
    made = rows.select(F.concat_ws("/", "filepath", "chunk_index").alias("id"), "filename", "filepath", "chunk_index", F.col("text").alias("document"), "embedding")
    path = scratch_path(spark, "collection")
    store_chunks(made, path)
    return open_collection(spark, path)


def _embed(df: DataFrame, text: str) -> DataFrame:
    return embedding.embed_chunks(df, text=text)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(search.query_hits(questions(spark, sf_dir), collection(spark, sf_dir), _embed), "hits")


HITS = f"""v AS {VARIATIONS}, c AS (SELECT filepath || '/' || chunk_index AS id, filename, filepath, chunk_index, text AS document FROM {CHUNKS}),
ce AS {embed_sql('c', 'id', 'document')}, qe AS {embed_sql('(SELECT DISTINCT query FROM v)', 'query', 'query')},
near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS r FROM
  (SELECT qe.query, ce.id, round(list_sum(list_transform(list_zip(qe.embedding, ce.embedding), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance FROM qe, ce) QUALIFY r <= 10),
hits AS (SELECT v.user_query, v.query, v.query_index, (r - 1)::INT AS result_index, distance, filename, filepath, chunk_index, document FROM v JOIN near USING (query) JOIN c USING (id))"""
RANKED = f"""{HITS}, g AS (SELECT user_query, filename, chunk_index, min({{'d': distance, 'q': query_index, 'r': result_index, 'query': query, 'document': document, 'filepath': filepath}}) AS b,
    list(query ORDER BY query_index, result_index) AS found_by, count(*)::INT AS total_matches, min({{'q': query_index, 'r': result_index}}) AS arrival FROM hits GROUP BY ALL),
s AS (SELECT *, 1 - b.d AS base, {importance_sql('b.query')} AS importance FROM g),
ranked AS (SELECT *, base * importance AS weighted, row_number() OVER (PARTITION BY user_query ORDER BY round(base * importance, 8) DESC, arrival)::INT AS rank FROM s QUALIFY rank <= 20)"""
_RANKED_COLUMNS = """user_query, rank, filename, b.filepath AS filepath, chunk_index, round(base, 6) AS base_score, round(importance, 6) AS importance, round(weighted, 8) AS weighted_score,
  array_to_string(found_by, '¦') AS found_by_queries, total_matches"""


def _shown(ranked: DataFrame) -> DataFrame:
    six = lambda c: F.round(c, 6).alias(c)
    return ranked.select(
        "user_query", "rank", "filename", "filepath", "chunk_index", six("base_score"), six("importance"), "weighted_score",
        F.array_join("found_by_queries", "¦").alias("found_by_queries"), "total_matches",
    )


def rank_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.rank_dedup(_hits(spark, sf_dir)))


def multi_query_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.multi_query_search(questions(spark, sf_dir), collection(spark, sf_dir), _embed))


SEARCH = f"WITH {RANKED} SELECT {_RANKED_COLUMNS} FROM ranked"


def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return search.search_counters(hits, search.rank_dedup(hits))


COUNTERS = f"""WITH {RANKED} SELECT user_query, count(DISTINCT query_index) AS total_queries, count(*) AS total_results_before_dedup, any_value(f) AS final_results_count
FROM hits JOIN (SELECT user_query, count(*) AS f FROM ranked GROUP BY user_query) USING (user_query) GROUP BY user_query"""


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    out = search.quality_metrics(search.rank_dedup(_hits(spark, sf_dir)), asked.unionByName(asked.limit(1).select(F.lit("never asked").alias("user_query"))))
    six = lambda c: F.round(c, 6).alias(c)
    return out.select(
        "user_query", six("average_score"), "high_quality", "medium_quality", "low_quality", six("diversity"), six("coverage"), "unique_documents", "total_queries_used", "no_results",
    )


METRICS = f"""WITH {RANKED}, m AS (SELECT user_query, count(*) AS n, avg(weighted) AS a, count(*) FILTER (weighted > 0.7) AS h, count(*) FILTER (weighted BETWEEN 0.4 AND 0.7) AS m,
  count(*) FILTER (weighted < 0.4) AS l, count(DISTINCT filename) AS u, len(list_distinct(flatten(list(found_by)))) AS q FROM ranked GROUP BY user_query)
SELECT user_query, round(a, 6) AS average_score, h AS high_quality, m AS medium_quality, l AS low_quality, round(u / n, 6) AS diversity, round(q / 6, 6) AS coverage, u AS unique_documents, q AS total_queries_used,
  false AS no_results FROM m UNION ALL SELECT 'never asked', 0, 0, 0, 0, 0, 0, 0, 0, true"""


def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.search_response(search.rank_dedup(_hits(spark, sf_dir)))
    return out.select("user_query", "filename", "content", "file_path", F.round("score", 6).alias("score"), "weighted_score", "total_matches")


RESPONSE = f"""WITH {RANKED} SELECT user_query, filename, b.document AS content, b.filepath AS file_path, round(base, 6) AS score, round(weighted, 8) AS weighted_score, total_matches FROM ranked"""

QUERIES = {
    "query_variations": (query_variations, f"SELECT * FROM {VARIATIONS}"),
    "repeat_query": (repeat_query, REPEATED),
    "parse_variations": (parse_variations, PARSED),
    "knn_search": (knn_search, knn_sql("embeddings")),
    "knn_filtered": (knn_filtered, knn_sql("embeddings", "c.label = 3")),
    "query_importance": (query_importance, IMPORTANCE),
    "rank_dedup": (rank_dedup, SEARCH),
    "multi_query_search": (multi_query_search, SEARCH),
    "search_counters": (search_counters, COUNTERS),
    "quality_metrics": (quality_metrics, METRICS),
    "search_response": (search_response, RESPONSE),
}
