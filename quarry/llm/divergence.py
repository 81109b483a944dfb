"""Source divergence audit: how far the sources of a language lie apart in their words, and by which words.

Terms are hashed to shards by language and term, and each shard is a small DuckDB database inside a task: it adds up
counts, finds the terms that stay, and makes the partial sums of every pair of sources and its own best terms by SQL.
Spark adds the sums and merges the rankings.

For a language with ``V`` kept terms and a group (or the language as a whole) with ``N`` occurrences of them, a term
with ``count`` occurrences weighs ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``, and two weights lie
``f = floor((p - q)^2 / (p + q))`` apart. Two sources differ by the sum of ``f`` over all kept terms. Most terms are
absent from most sources, so a shard only sums what differs from two absent terms: with ``p0`` for the weight of an
absent one,

    sum f = V f(p0, q0) + sum over terms of one source of [f(p, q0) - f(p0, q0)], and the same of the other,
            + sum over terms of both of [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

which is the same whole number. The first term is added by Spark, the second is taken by distinct weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored, table

MIN_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: Bytes of text that DuckDB splits at once, and of a piece of a longer text; rows held before they are added up.
TEXT_BYTES, PIECE_BYTES, HELD_ROWS = 8 << 20, 1 << 20, 1_000_000
#: Rows of a shard, about, from the least to the most; each is audited by one call, and makes a row for each pair of sources.
SHARD_ROWS = 50_000, 500_000

#: Every byte that is no letter and not beyond ASCII becomes a space, A-Z become lower case.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _database() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("SET preserve_insertion_order = false")
    return con


def _cut(text: bytes) -> list[bytes]:
    """``text`` in pieces of about PIECE_BYTES, cut at spaces."""
    out, at = [], 0
    while len(text) - at > PIECE_BYTES:
        end = text.find(b" ", at + PIECE_BYTES)
        if end < 0:
            break
        out.append(text[at:end])
        at = end + 1
    return [*out, text[at:]]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """``row, lang, source, text`` with folded texts, of about TEXT_BYTES each; a text is never in two of them."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + TEXT_BYTES, side="right")) - 1)
            rows, folded = [], []
            for i in range(start, stop):
                text = texts[i].as_buffer().to_pybytes().translate(_FOLDED)
                pieces = [text] if len(text) <= PIECE_BYTES else _cut(text)
                rows += [i] * len(pieces)
                folded += pieces
            at = pa.array(rows, pa.int32())
            yield pa.table({"row": at, "lang": batch.column("lang").take(at), "source": batch.column("source").take(at), "text": pa.array(folded, pa.binary()).cast(pa.string())})
            start = stop


_COUNTED = "lang string, source string, term string, n long, docs long"


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term of every group, of what one task has read."""
    con = _database()
    con.execute("CREATE TABLE found (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    sums = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM found GROUP BY ALL"
    for part in _slices(batches):
        con.execute("""
            INSERT INTO found
            SELECT lang, source, term, sum(n), count(*)
            FROM (SELECT "row", lang, source, term, count(*) AS n
                  FROM (SELECT "row", lang, source, unnest(string_split(text, ' ')) AS term FROM part) WHERE term <> '' GROUP BY ALL)
            GROUP BY ALL""")
        if con.execute("SELECT count(*) FROM found").fetchall()[0][0] > HELD_ROWS:
            yield from con.sql(sums).to_arrow_table().to_batches(50_000)
            con.execute("DELETE FROM found")
    yield from con.sql(sums).to_arrow_table().to_batches(50_000)


_KEPT = "lang string, term string, source string, n long, first int"


def _keep_terms(min_docs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of the terms that enough documents of their language have; ``first`` is 1 in one row of each term."""
    con = _database()
    con.execute("CREATE TABLE found (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    fresh = 0
    for batch in batches:
        con.register("batch", pa.Table.from_batches([batch]))
        con.execute("INSERT INTO found SELECT lang, source, term, n, docs FROM batch")
        fresh += batch.num_rows
        if fresh > HELD_ROWS:
            con.execute("CREATE OR REPLACE TABLE found AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM found GROUP BY ALL")
            fresh = 0
    con.execute(f"""
        CREATE TABLE kept AS
        SELECT lang, term, source, sum(n)::BIGINT AS n FROM found
        WHERE (lang, term) IN (SELECT (lang, term) FROM found GROUP BY lang, term HAVING sum(docs) >= {min_docs}) GROUP BY ALL""")
    out = con.sql("SELECT lang, term, source, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::INTEGER AS first FROM kept")
    yield from out.to_arrow_table().to_batches(50_000)


_AUDITED = "lang string, part string, source string, item string, value decimal(38,0)"
_F = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"


def _audit_shard(top: int, kept: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial pair sums (source before item) and the best terms of each source, of one shard of one language."""
    con = _database()
    lang = groups.column("lang")[0].as_py()
    codes = kept.column("term").combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    rows = pa.table({"t": codes.indices, "source": kept.column("source"), "n": kept.column("n")})  # noqa: F841
    terms = pa.table({"t": pa.array(np.arange(len(codes.dictionary), dtype=np.int32)), "term": codes.dictionary})  # noqa: F841
    con.execute(f"""
        CREATE TABLE g AS
        SELECT source, row_number() OVER (ORDER BY source) AS s, n_group + 2 * v AS whole, n_lang + 2 * v AS all_whole,
               1 + ({2 * SCALE}::HUGEINT // (n_group + 2 * v))::BIGINT AS p0 FROM groups""")
    con.execute(f"""
        CREATE TABLE x AS
        SELECT t, s, n, 1 + ({SCALE}::HUGEINT * (n + 2) // whole)::BIGINT AS p, p0, all_whole FROM rows JOIN g USING (source)""")
    both = f"{_F.format('a.p', 'b.p')} - {_F.format('a.p', 'b.p0')} - {_F.format('a.p0', 'b.p')} + {_F.format('a.p0', 'b.p0')}"
    alone = f"c * ({_F.format('h.p', 'g.p0')} - {_F.format('h.p0', 'g.p0')})"
    out = con.sql(f"""
        WITH part AS (
            SELECT a.s AS a, b.s AS b, sum({both}) AS value FROM x a JOIN x b ON a.t = b.t AND a.s < b.s GROUP BY ALL
            UNION ALL
            SELECT least(h.s, g.s), greatest(h.s, g.s), sum({alone}) FROM (SELECT s, p, p0, count(*) AS c FROM x GROUP BY ALL) h JOIN g ON g.s <> h.s GROUP BY ALL),
        q AS (SELECT t, 1 + ({SCALE}::HUGEINT * (sum(n)::HUGEINT + 2) // any_value(all_whole))::BIGINT AS q FROM x GROUP BY t),
        best AS (SELECT s, t, {_F.format('p', 'q')} AS value FROM x JOIN q USING (t) WHERE p > q),
        ranked AS (SELECT s, term, value FROM best JOIN terms USING (t) QUALIFY row_number() OVER (PARTITION BY s ORDER BY value DESC, term) <= {top})
        SELECT 'pair' AS part, ga.source AS source, gb.source AS item, sum(value)::DECIMAL(38, 0) AS value
        FROM part JOIN g ga ON ga.s = a JOIN g gb ON gb.s = b GROUP BY ALL
        UNION ALL
        SELECT 'term', source, term, value::DECIMAL(38, 0) FROM ranked JOIN g USING (s)""").to_arrow_table()
    return out.add_column(0, "lang", pa.array([lang] * out.num_rows, pa.string()))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from each other one (part ``pair``)
    and its ``top`` terms that it uses more than its language does (part ``term``).

    Null texts, languages and sources count as ''. A row is a document, also if rows repeat, and a group without terms
    has pairs too. A language without kept terms has pairs of value 0. Ties go by ``item`` in the order of UTF-8 bytes.
    An empty table gives no rows; columns other than the three named are never read. Texts of any length are counted
    whole, in pieces of 1 MiB. All pairs of a language's sources are what is asked for, so they alone grow as a square;
    nothing that is made before them does.
    """
    spark = docs.sparkSession
    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))))
    counted = own.mapInArrow(_count_texts, _COUNTED)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _keep_terms(min_docs, batches)

    kept = stored(counted.repartition(parts, "lang", "term").mapInArrow(keep, _KEPT), "terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("v"))
    groups = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0)
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("v").alias("v"))
    groups = stored(groups.select("lang", "source", F.col("n").alias("n_group")).join(langs, "lang"), "groups")

    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s")).agg(F.max("s")).first()[0] or 0
    shards = 1 + kept.count() // min(max(most * most // 2, SHARD_ROWS[0]), SHARD_ROWS[1])
    kept = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)))
    places = kept.select(F.col("lang").alias("lang"), F.col("shard").alias("at")).distinct()
    totals_at = groups.join(places, "lang")

    def audit_shard(rows: pa.Table, totals: pa.Table) -> pa.Table:
        return _audit_shard(top, rows, totals)

    audited = kept.groupBy("lang", "shard").cogroup(totals_at.groupBy("lang", "at")).applyInArrow(audit_shard, _AUDITED)
    audited = stored(audited.groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value")), "audited")

    shown = ["lang", "source", "part", "item", "value"]
    p0 = F.when(F.col("v") > 0, F.expr(f"1 + {2 * SCALE}L div (n_group + 2 * v)")).otherwise(0)
    absent = groups.select("lang", "source", "v", p0.alias("p0"))
    other = absent.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    halves = audited.filter("part = 'pair'").drop("part")
    sums = halves.unionByName(halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = absent.join(other, "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left")
    base = F.expr("CASE WHEN v > 0 THEN v * ((p0 - q0) * (p0 - q0) div (p0 + q0)) ELSE 0 END")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce(F.col("value"), F.lit(0))).cast("long").alias("value"))
    terms = audited.filter("part = 'term'").select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked_terms = terms.select(*shown, rank.alias("rank")).filter(F.col("rank") <= top)
    return pairs.select(*shown, rank.alias("rank")).unionByName(ranked_terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
o AS (SELECT r, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
      FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '{_TERM_PATTERN}')) AS t FROM d)),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (gn.n + 2 * v.v))::BIGINT AS p
      FROM gn JOIN v ON v.lang = gn.lang JOIN k ON k.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
ln AS (SELECT lang, sum(n) AS n FROM gn GROUP BY lang),
q AS (SELECT t.lang, t.term, 1 + (1000000000::HUGEINT * (t.n + 2) // (ln.n + 2 * v.v))::BIGINT AS q
      FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) t JOIN ln ON ln.lang = t.lang JOIN v ON v.lang = t.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::BIGINT AS value
          FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
