"""Nearest-neighbour search and multi-query search over whole tables of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip_ws
from quarry.sources.scratch import stored

PER_QUERY, GLOBAL_LIMIT, VARIATIONS = 10, 20, 6
#: Queries, and rows of the collection, in a block; a pair of blocks is one matrix product.
QUERY_BLOCK = ROW_BLOCK = 1024
#: Bytes of the vectors of a part of the collection, and the most that a block of queries may have to be broadcast.
PART_BYTES = BROADCAST_BYTES = 64 << 20
#: Word groups and how much they add to a query's importance.
IMPORTANCE = (
    ("best|top|popular|effective", 0.2),
    ("how|what|why|when|where", 0.1),
    ("tutorial|guide|learn|beginner", 0.15),
)
MANY_WORDS, MANY_WORDS_COST = 8, 0.1
HIGH_SCORE, LOW_SCORE = 0.7, 0.4


def query_variations(questions: DataFrame, key: str = "user_query") -> DataFrame:
    """Six rows for each question: ``query_index`` from 1 and ``query``, beside the other columns."""
    q = strip_ws(F.col(key))
    forms = [q, *(F.concat(F.lit(p), q) for p in ("what is ", "how to ", "best ")), *(F.concat(q, F.lit(s)) for s in (" examples", " tutorial"))]
    rows = questions.select("*", F.posexplode(F.array_distinct(F.array(*forms))).alias("__i", "query"))
    return rows.withColumn("query_index", F.col("__i") + 1).drop("__i")


def repeat_query(questions: DataFrame, key: str = "user_query", n: int = VARIATIONS) -> DataFrame:
    """The question itself ``n`` times, for use without a generator."""
    rows = questions.select("*", F.posexplode(F.array_repeat(F.col(key), n)).alias("__i", "query"))
    return rows.withColumn("query_index", F.col("__i") + 1).drop("__i")


def parse_variations(answers: DataFrame, answer: str = "answer", n: int = VARIATIONS) -> DataFrame:
    """``queries``: numbered lines of a model's answer, padded with the first one and cut to ``n``."""
    lines = F.transform(F.split(F.coalesce(F.col(answer), F.lit("")), "\n"), strip_ws)
    numbered = F.filter(lines, lambda x: x.rlike(r"(?U)^\d") & F.contains(x, F.lit(".")))
    texts = F.filter(F.transform(numbered, lambda x: strip_ws(F.substring(x, F.instr(x, ".") + 1, F.length(x)))), lambda x: x != "")
    out = answers.withColumn("queries", texts)
    first = F.coalesce(F.get("queries", F.lit(0)), F.lit("search query"))
    return out.withColumn("queries", F.slice(F.concat("queries", F.array_repeat(first, n)), 1, n))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in order."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def _packed(rows: DataFrame, key: str, embedding: str, size: int, name: str) -> DataFrame:
    """Rows by blocks of ``size``: ``dim, <name>_ids, <name>_x``, the ids and the vectors as one matrix of doubles.

    Rows without a vector, or with a null in it, are left out.
    """
    keys = dict(rows.dtypes)[key]
    names = ["dim", f"{name}_ids", f"{name}_x"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, parts = held.pop(dim)
            kind = pa.list_(ids[0].type)
            arrays = [pa.array([dim], pa.int32()), pa.array([pa.concat_arrays(ids).to_pylist()], kind), pa.array([np.concatenate(parts).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            widths = pc.fill_null(pc.list_value_length(batch.column(1)), -1).to_numpy(zero_copy_only=False)
            for dim in np.unique(widths[widths > 0]).tolist():
                part = batch.filter(pa.array(widths == dim))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                whole = ~np.isnan(x).any(axis=1)
                x, ids = x[whole], part.column(0).filter(pa.array(whole))
                for at in range(0, len(x), size):
                    have = held.setdefault(dim, ([], []))
                    have[0].append(ids.slice(at, size))
                    have[1].append(x[at : at + size])
                    if sum(map(len, have[0])) >= size:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    wanted = rows.select(F.col(key).alias("k"), F.col(embedding).cast("array<double>").alias("v"))
    return wanted.mapInArrow(pack, f"dim int, {name}_ids array<{keys}>, {name}_x binary")


class _Best:
    """The ``k`` nearest rows so far of each query of a block, by distance to 6 places and then by id."""

    def __init__(self, ids: pa.Array, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.lengths = (q * q).sum(axis=1)
        self.found: list[tuple[np.ndarray, list]] = [(np.zeros(0), []) for _ in range(len(q))]
        self.limits = np.full(len(q), np.inf)

    def meet(self, keys: list, x: np.ndarray) -> None:
        """The product form cancels digits, so it only chooses the rows whose exact distance is taken."""
        near = self.lengths[:, None] + (x * x).sum(axis=1)[None, :] - 2 * self.q @ x.T
        slack = lambda d: d + 1e-5 * (1 + np.abs(d))
        for i in np.flatnonzero(near.min(axis=1) <= slack(self.limits)).tolist():
            row = near[i]
            limit = min(self.limits[i], np.partition(row, self.k - 1)[self.k - 1] if len(row) > self.k else np.inf)
            take = np.flatnonzero(row <= slack(limit))
            d = np.floor(((x[take] - self.q[i]) ** 2).sum(axis=1) * 1e6 + 0.5) / 1e6
            d, names = np.concatenate([self.found[i][0], d]), self.found[i][1] + [keys[j] for j in take.tolist()]
            if len(d) > self.k:
                first = sorted(range(len(d)), key=lambda j: (d[j], names[j] is not None, names[j]))[: self.k]
                d, names = d[first], [names[j] for j in first]
            if len(d) == self.k:
                self.limits[i] = d.max()
            self.found[i] = (d, names)

    def rows(self, kind: pa.DataType, id_name: str) -> pa.RecordBatch:
        counts = [len(d) for d, _ in self.found]
        columns = [
            self.ids.take(pa.array(np.repeat(np.arange(len(counts)), counts))),
            pa.array([n for _, names in self.found for n in names], kind),
            pa.array(np.concatenate([d for d, _ in self.found])),
        ]
        return pa.RecordBatch.from_arrays(columns, ["__q", id_name, "distance"])


def nearest_by_part(rows: DataFrame, queries: DataFrame, k: int, id_col: str, query_id: str, embedding: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """``__q, id, distance``: up to ``k`` rows of each query from every part of ``rows``.

    A block-nested join. Rows are packed into blocks and dealt to parts of about ``part_bytes``; a copy of every block of
    queries goes to every part. The sort-merge join streams the blocks of queries and keeps the part's blocks of rows beside
    them, so a task sees all of the part for one block of queries before the next one, and holds the nearest rows of that
    one only. What leaves the tasks is parts x queries x ``k`` rows at most.
    """
    kinds = dict(rows.dtypes) | {query_id: dict(queries.dtypes)[query_id]}
    asked = stored(_packed(queries, query_id, embedding, QUERY_BLOCK, "q"), "queries")
    blocks = _packed(rows, id_col, embedding, ROW_BLOCK, "r")
    size = asked.agg(F.count(F.lit(1)), F.max("dim"), F.sum(F.octet_length("q_x"))).first()
    if size[0] <= 1 and (size[2] or 0) <= BROADCAST_BYTES:
        pairs = blocks.join(F.broadcast(asked), "dim")
    else:
        parts = 1 + rows.count() * size[1] * 8 // part_bytes
        dealt = blocks.withColumn("part", F.pmod(F.xxhash64("r_x"), F.lit(parts)))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        pairs = asked.hint("merge").join(dealt, ["dim", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, sign, ids, kind = None, None, None, None
        for batch in batches:
            kind = batch.column(3).type.value_type
            for dim, q_ids, q, r_ids, x in zip(*batch.columns):
                if best is None or q_ids != ids or q.as_buffer() != sign:
                    if best is not None:
                        yield best.rows(kind, id_col)
                    sign, ids = q.as_buffer(), q_ids
                    best = _Best(q_ids.values, np.frombuffer(sign).reshape(-1, dim.as_py()), k)
                best.meet(r_ids.as_py(), np.frombuffer(x.as_buffer()).reshape(-1, dim.as_py()))
        if best is not None:
            yield best.rows(kind, id_col)

    return pairs.select("dim", "q_ids", "q_x", "r_ids", "r_x").mapInArrow(run, f"__q {kinds[query_id]}, `{id_col}` {kinds[id_col]}, distance double")


def knn_search(
    collection: DataFrame, queries: DataFrame, k: int = PER_QUERY, id_col: str = "id", query_id: str = "query_id", embedding: str = "embedding", where: Column | None = None
) -> DataFrame:
    """``query_id, id, distance, rank`` of the ``k`` nearest rows of every query, by squared distance and then by id.

    Both tables are packed into blocks of 1,024 vectors, and blocks of queries meet blocks of rows in tasks, a matrix
    product each. A single block of queries of at most 64 MB is broadcast, so the collection isn't moved; more are joined
    part by part, see :func:`nearest_by_part`, so nothing goes through the driver. ``where`` restricts the collection before the
    search. Rows without a vector of the query's width are never hits; distances are rounded to 6 places.
    """
    rows = collection.filter(where) if where is not None else collection
    near = nearest_by_part(rows, queries, k, id_col, query_id, embedding)
    rank = F.row_number().over(Window.partitionBy("__q").orderBy("distance", id_col))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("__q", query_id)


def query_importance(query: Column) -> Column:
    """From 0.5 to 1.5 by word groups (as substrings) and length."""
    low = F.lower(query)
    out = F.lit(1.0)
    for group, more in IMPORTANCE:
        out = out + F.when(low.rlike(group), F.lit(more)).otherwise(F.lit(0.0))
    n = F.size(F.filter(F.split(query, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    out = out - F.when(n > MANY_WORDS, F.lit(MANY_WORDS_COST)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.5), F.least(F.lit(1.5), out))


def rank_dedup(hits: DataFrame, limit: int = GLOBAL_LIMIT, key: str = "filename") -> DataFrame:
    """One row for each ``user_query, filename, chunk_index`` of its hits, ranked by weighted score, ``limit`` at most.

    The nearest hit stays, of equally near ones the first to arrive (``query_index``, then ``result_index``). A missing
    name counts as ``unknown``, a missing chunk as 0, a missing distance as 1. Equal scores are ranked by arrival.
    """
    rows = hits.withColumns(
        {key: F.coalesce(key, F.lit("unknown")), "chunk_index": F.coalesce("chunk_index", F.lit(0)), "distance": F.coalesce("distance", F.lit(1.0))}
    )
    rest = F.struct("query", "document", *(c for c in ("filepath", "filename") if c in hits.columns and c != key))
    groups = rows.groupBy("user_query", key, "chunk_index").agg(
        F.min(F.struct("distance", "query_index", "result_index", rest.alias("rest"))).alias("best"),
        F.array_sort(F.collect_list(F.struct("query_index", "result_index", "query"))).alias("all"),
        F.count(F.lit(1)).cast("int").alias("total_matches"),
        F.min(F.struct("query_index", "result_index")).alias("arrival"),
    )
    base = 1 - F.col("best.distance")
    importance = query_importance(F.col("best.rest.query"))
    scored = groups.select(
        "user_query", key, "chunk_index", "best.rest.*", F.col("best.distance").alias("distance"), base.alias("base_score"), importance.alias("importance"),
        # A distance has 6 places and an importance 2, so the score is exact with 8, whichever engine rounds it.
        F.round(base * importance, 8).alias("weighted_score"), F.transform("all", lambda x: x["query"]).alias("found_by_queries"), "total_matches", "arrival",
    )
    order = Window.partitionBy("user_query").orderBy(F.desc("weighted_score"), "arrival")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("arrival")


def query_hits(questions: DataFrame, collection: DataFrame, embed, per_query: int = PER_QUERY, variations=query_variations) -> DataFrame:
    """Hits of every variation of every question: what :func:`rank_dedup` takes.

    ``collection`` has ``id, filename, filepath, chunk_index, document, embedding`` and is read twice, so it should be a
    stored one, not one that is yet to be embedded; ``embed`` adds the same encoder's ``embedding`` to a frame for the
    text column it is given. Equal variations are searched once.
    """
    asked = variations(questions.select("user_query").distinct())
    vectors = embed(asked.select("query").distinct(), "query")
    near = knn_search(collection, vectors, per_query, "id", "query")
    hits = asked.join(near, "query").join(collection.drop("embedding", "distance", "rank"), "id")
    return hits.withColumn("result_index", F.col("rank") - 1).drop("rank")


def multi_query_search(questions: DataFrame, collection: DataFrame, embed, per_query: int = PER_QUERY, limit: int = GLOBAL_LIMIT) -> DataFrame:
    """Ranked answers to a table of questions: six variations each, nearest chunks of each, deduplicated and scored."""
    return rank_dedup(query_hits(questions, collection, embed, per_query), limit)


def search_counters(hits: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per question: number of variations with hits, hits before and rows after deduplication."""
    before = hits.groupBy("user_query").agg(F.count_distinct("query_index").alias("total_queries"), F.count(F.lit(1)).alias("total_results_before_dedup"))
    after = ranked.groupBy("user_query").agg(F.count(F.lit(1)).alias("final_results_count"))
    return before.join(after, "user_query", "left").na.fill(0, ["final_results_count"])


def quality_metrics(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: mean score, scores by class, share of distinct files, share of the six variations that found a row."""
    score = F.col("weighted_score")
    main = ranked.groupBy("user_query").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("weighted_score").alias("average_score"),
        F.count_if(score > HIGH_SCORE).alias("high_quality"),
        F.count_if((score >= LOW_SCORE) & (score <= HIGH_SCORE)).alias("medium_quality"),
        F.count_if(score < LOW_SCORE).alias("low_quality"),
        F.count_distinct("filename").alias("unique_documents"),
    )
    used = ranked.select("user_query", F.explode("found_by_queries").alias("q")).groupBy("user_query").agg(F.count_distinct("q").alias("total_queries_used"))
    out = questions.select("user_query").distinct().join(main, "user_query", "left").join(used, "user_query", "left")
    out = out.withColumn("no_results", F.col("n").isNull()).na.fill(0)
    return out.select(
        "user_query", "average_score", "high_quality", "medium_quality", "low_quality",
        F.when(F.col("n") > 0, F.col("unique_documents") / F.col("n")).otherwise(0.0).alias("diversity"),
        (F.col("total_queries_used") / 6.0).alias("coverage"), "unique_documents", "total_queries_used", "no_results",
    )


def search_response(ranked: DataFrame) -> DataFrame:
    """Rows as a caller gets them."""
    return ranked.select(
        "user_query", F.coalesce("filename", F.lit("Unknown")).alias("filename"), F.col("document").alias("content"), F.col("filepath").alias("file_path"),
        F.col("base_score").alias("score"), "weighted_score", "importance", F.col("found_by_queries").alias("found_by"), "total_matches",
    )
