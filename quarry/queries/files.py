"""Files and collections."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.jobs import index, log
from quarry.operators import embedding, markdown, metadata
from quarry.queries import frames as fr
from quarry.queries import vectors
from quarry.queries.chunks import token_sql
from quarry.queries.frames import embed_sql
from quarry.queries.texts import ASSEMBLED, assemble_pages
from quarry.queries.vectors import CHUNKS
from quarry.sources import collection, files
from quarry.sources.scratch import scratch_path
from quarry.streaming.index import stream_index as run_stream


#: Documents of a source that lie in one file, by their ids.
IN_A_FILE = 1000


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, part, docs``: up to IN_A_FILE documents of a source in order, as structs of ``doc_id, lang, text``."""
    rows = fr.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").withColumn("part", F.floor(F.col("doc_id") / IN_A_FILE))
    return rows.groupBy("source", "part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "lang", "text"))).alias("docs"))


def _lines(text: Callable[[Column], Column]) -> Column:
    """The texts of ``docs`` behind one another, each closed by a line break."""
    return F.concat(F.array_join(F.transform("docs", text), "\n"), F.lit("\n"))


def _plain_file(top: str) -> Column:
    path = F.concat(F.lit(f"{top}/source="), "source", F.lit("/"), F.col("part").cast("string"), F.lit(".txt"))
    return F.struct(path.alias("path"), _lines(lambda d: d["text"]).alias("content"))


def _marked_file(top: str) -> Column:
    """The same documents as markdown with front matter."""
    front = F.concat(F.lit("---\nTitle: all of "), "source", F.lit("\ntags: one\n    two\n---\n"))
    path = F.concat(F.lit(f"{top}/_md/"), "source", F.lit("/"), F.col("part").cast("string"), F.lit(".md"))
    body = _lines(lambda d: fr.marked(lambda c: F.col("source") if c == "source" else d[c]))
    return F.struct(path.alias("path"), F.concat(front, body).alias("content"))


def tree(spark: SparkSession, sf_dir: str, kinds: Iterable[Callable[[str], Column]] = (_plain_file,)) -> str:
    """All documents in files of the given kinds, text files if none are given, a folder for each source; texts are grouped once for all kinds."""
    top = files.full_path(spark, scratch_path(spark, "tree"))
    made = _grouped(spark, sf_dir).select(F.explode(F.array(*[kind(top) for kind in kinds])).alias("file"))
    files.write_files(made.select("file.path", "file.content"))
    return top


_TREE = f"(SELECT source, doc_id // {IN_A_FILE} AS part, string_agg(text || chr(10), '' ORDER BY doc_id) AS text FROM documents GROUP BY ALL)"


def _source():
    return F.regexp_extract("path", "source=([^/]*)", 1).alias("source")


def crawl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the files found for each source."""
    return files.crawl_files(spark, tree(spark, sf_dir)).groupBy(_source()).agg(F.sum("length").alias("bytes"))


CRAWLED = "SELECT source, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY source"


def read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = files.read_text(spark, tree(spark, sf_dir))
    return read.groupBy(_source(), "encoding").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit("\n"))).alias("line_breaks"))


READ = """SELECT source, 'utf-8' AS encoding, sum(length(text) + 1)::BIGINT AS chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS line_breaks
FROM documents GROUP BY source"""


def filter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.filter_files(fr.files(spark, sf_dir)).select("path", "length")


FILTERED = r"""SELECT path, length FROM {0} WHERE regexp_matches(lower(path), '\.(pdf|docx?|txt|md|png|jpe?g|gif|bmp|tiff)$') AND length <= 52428800""".format(fr.FILES)


def file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_info(fr.files(spark, sf_dir))


INFO = rf"""SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '[^/.][^/]*(\.[^./]+)$', 1)) AS extension, length AS size, modificationTime AS modified FROM {fr.FILES}"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metadata.chunk_ids(vectors.chunks(spark, sf_dir))
    made = embedding.embed_chunks(rows.select("filepath", "chunk_index", "text"))
    path = scratch_path(spark, "collection")
    collection.open_collection(spark, path)
    collection.store_chunks(metadata.chunk_metadata(rows).withColumnRenamed("text", "document"), path, made)
    return collection.open_collection(spark, path)


def store_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _stored(spark, sf_dir)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return back.select("id", "filepath", "chunk_index", "total_chunks", "document", F.round(total, 6).alias("vector_sum"), F.col("metadata")["filename"].alias("meta_filename"))


STORED = f"""WITH c AS (SELECT *, filepath || '/' || chunk_index AS k FROM {CHUNKS}), e AS {embed_sql('c', 'k', 'text')}
SELECT filename || '_' || chunk_index || '_' || md5(filepath || chr(31) || chunk_index || chr(31) || text)[1:8] AS id, filepath, chunk_index, total_chunks, text AS document,
  round(list_sum(embedding), 6) AS vector_sum, filename AS meta_filename FROM c JOIN e USING (k)"""


def collection_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a collection as made, as filled, filled again without new ids, and as reset."""
    path = scratch_path(spark, "collection")
    count = lambda df, state: collection.collection_count(df).withColumn("state", F.lit(state))
    made = count(collection.open_collection(spark, path), "made").collect()
    rows = metadata.chunk_ids(vectors.chunks(spark, sf_dir)).withColumnRenamed("text", "document")
    encode = lambda df: embedding.embed_chunks(df, text="document")
    collection.store_chunks(rows, path, encode=encode)
    filled = count(collection.open_collection(spark, path), "filled").collect()
    collection.store_chunks(rows, path, skip_existing=True, encode=encode)
    again = count(collection.open_collection(spark, path), "again").collect()
    reset = count(collection.open_collection(spark, path, reset=True), "reset").collect()
    return spark.createDataFrame([*made, *filled, *again, *reset], "count long, state string")


OPENED = f"""WITH n AS (SELECT count(*) AS n FROM {CHUNKS}) SELECT 'made' AS state, 0::BIGINT AS count UNION ALL SELECT 'filled', n FROM n UNION ALL SELECT 'again', n FROM n UNION ALL SELECT 'reset', 0"""


def collection_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.collection_count(_stored(spark, sf_dir))


def _beside(spark: SparkSession, sf_dir: str, top: str, name: str, content) -> DataFrame:
    """A further file for each source: ``path, content``."""
    sources = fr.table(spark, sf_dir, "documents").select("source").distinct()
    return sources.select(F.concat(F.lit(f"{top}/source="), "source", F.lit(f"/{name}")).alias("path"), content.alias("content"))


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the incremental job stores of all documents, by source, after two runs.

    Beside each source lie a file of which a chunk is blank and an empty one, which fail and don't hinder the others, one below a
    folder with an underscore, one that is edited between the runs and one that is deleted.
    """
    top, target, at = tree(spark, sf_dir), scratch_path(spark, "collection"), scratch_path(spark, "stream")
    for name, content in (("blank.txt", _GAP), ("empty.txt", ""), ("edited.txt", "first version"), ("gone.txt", "gone")):
        files.write_files(_beside(spark, sf_dir, top, name, F.lit(content)))
    files.write_files(_beside(spark, sf_dir, top, "_notes/n.txt", F.concat(F.lit("Notes of "), "source")))
    run_stream(spark, top, target, at).awaitTermination()
    files.write_files(_beside(spark, sf_dir, top, "edited.txt", F.concat(F.lit("second version of "), "source")))
    files.remove_files(_beside(spark, sf_dir, top, "gone.txt", F.lit("")))
    run_stream(spark, top, target, at).awaitTermination()
    stored = collection.open_collection(spark, target)
    chars = F.sum(F.length("document"))
    return stored.groupBy(F.regexp_extract("filepath", "source=([^/]*)", 1).alias("source")).agg(F.count_distinct("filepath").alias("files"), F.count(F.lit(1)).alias("chunks"), chars.alias("chars"))


STREAMED = f"""SELECT source, count(DISTINCT part) + 2 AS files, count(*) + 2 AS chunks, (sum(chunk_size) + length('Notes of second version of ') + 2 * length(source))::BIGINT AS chars
FROM {token_sql(_TREE, 'source, part')} GROUP BY source"""


def index_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log says of jobs over all documents: one in which a file of each source fails, one that reads those again when
    they are mended, one that indexes the whole again, one over a folder that isn't there, and one that waits."""
    top, target, at = tree(spark, sf_dir), scratch_path(spark, "collection"), scratch_path(spark, "jobs")
    files.write_files(_beside(spark, sf_dir, top, "mended.txt", F.lit(" ")))
    first = log.run_job(spark, at, "first", lambda: index.index_directory(spark, top, target))
    files.write_files(_beside(spark, sf_dir, top, "mended.txt", F.col("source")))
    log.run_job(spark, at, "retry", lambda: index.retry_failed(first, target))
    log.run_job(spark, at, "again", lambda: index.index_directory(spark, top, target))
    try:
        log.run_job(spark, at, "nowhere", lambda: index.index_directory(spark, f"{top}/none", target))
    except FileNotFoundError:
        pass
    log.queue_job(spark, at, "waiting")
    stored = collection.open_collection(spark, target).agg(F.count(F.lit(1)).alias("stored"))
    states = log.job_states(spark, at).crossJoin(F.broadcast(stored))
    error = F.regexp_extract("error_message", "^[^:]*", 0)
    return states.select("job_id", "status", "files_processed", "files_successful", "files_failed", "total_chunks", F.size("failed_files").alias("shown"), error.alias("error"), "stored")


JOBS = f"""WITH c AS (SELECT count(*) AS n, count(DISTINCT (source, part)) AS f FROM {token_sql(_TREE, 'source, part')}), s AS (SELECT count(DISTINCT source) AS s FROM documents)
SELECT job_id, status, f + s AS files_processed, f + s - bad AS files_successful, bad AS files_failed, n + s - bad AS total_chunks, least(10, bad)::INT AS shown, NULL AS error, n + s AS stored
FROM c, s, (SELECT 'first' AS job_id, 'completed' AS status, s AS bad FROM s UNION ALL SELECT 'retry', 'completed', 0 UNION ALL SELECT 'again', 'completed', 0)
UNION ALL SELECT j, st, NULL, NULL, NULL, NULL, NULL, e, n + s FROM c, s, (VALUES ('nowhere', 'failed', 'Directory not found'), ('waiting', 'queued', NULL)) v(j, st, e)"""

#: A text with white space that fills whole chunks.
_GAP = "before" + " " * 2000 + "after"


def index_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexing job over a tree of all documents as text and as markdown with front matter, the latter below a folder with
    an underscore, all conversations as decoded PDF files, and a file that fails of each kind for each source."""
    top = tree(spark, sf_dir, (_plain_file, _marked_file))
    pdf = F.concat(F.lit("/"), F.col("conv_id").cast("string"), F.lit(".pdf"))
    sources = fr.table(spark, sf_dir, "documents").select("source").distinct()
    failing = sources.select(F.explode(F.create_map(*[F.lit(x) for pair in _FAILING for x in pair])).alias("kind", "content"), "source")
    chats = assemble_pages(spark, sf_dir).select(F.concat(F.lit(top), pdf).alias("filepath"), "content", F.create_map(F.lit("total_pages"), F.col("total_pages").cast("string")).alias("metadata"))
    written = failing.select(F.concat(F.lit(f"{top}/"), "source", "kind").alias("path"), "content")
    files.write_files(written.union(chats.select("filepath", F.lit("%PDF"))))
    target = scratch_path(spark, "collection")
    results = index.index_directory(spark, top, target, parsed=chats)
    kept = collection.open_collection(spark, target).groupBy(F.col("filepath").alias("file_path")).agg(
        F.max(F.col("metadata")["title"]).alias("title"), F.max(F.col("metadata")["tags"]).alias("tags"), F.max(F.col("metadata")["total_pages"]).alias("total_pages"), F.sum(F.length("document")).alias("chars")
    )
    place = F.regexp_extract("file_path", "quarry-tree-[0-9a-f]*/(.*)", 1)
    return results.join(kept, "file_path", "left").select(place.alias("file_path"), "success", "chunks_created", "chunks_stored", "error_message", "title", "tags", "total_pages", "chars")


_FAILING = (("/gap.txt", _GAP), ("/blank.txt", " \n"), ("/none.md", ""), ("/odd.xyz", "x"), ("/not.docx", "x"))


def _plain_sql(x: str) -> str:
    for pattern, group in markdown.PLAIN:
        x = f"regexp_replace({x}, '(?m){pattern}', '{chr(92) + group if group else ''}', 'g')"
    return x


_MARKED = f"(SELECT source, doc_id // {IN_A_FILE} AS part, string_agg(m.text || chr(10), '' ORDER BY doc_id) AS text FROM {fr.MARKDOWN} m JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY ALL)"
_INDEXED = f"""(SELECT 'source=' || source || '/' || part || '.txt' AS f, text, NULL AS title, NULL AS tags, NULL AS total_pages FROM {_TREE}
  UNION ALL SELECT '_md/' || source || '/' || part || '.md', {_plain_sql('text')}, 'all of ' || source, '["one","two"]', NULL FROM {_MARKED}
  UNION ALL SELECT conv_id || '.pdf', content, NULL, NULL, total_pages::VARCHAR FROM ({ASSEMBLED}))"""
INDEXED = f"""SELECT f AS file_path, true AS success, count(*) AS chunks_created, count(*) AS chunks_stored, NULL AS error_message, title, tags, total_pages, sum(chunk_size)::BIGINT AS chars
  FROM {token_sql(_INDEXED, 'f, title, tags, total_pages')} GROUP BY ALL
UNION ALL SELECT source || f, false, n, 0, e, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT source FROM documents), (VALUES
  ('/gap.txt', 5, 'Embedding count mismatch: 5 chunks, 2 embeddings'), ('/blank.txt', 0, 'No chunks created from text'), ('/none.md', 0, 'No content extracted from file'),
  ('/not.docx', 0, 'Processing error: no decoded content for this docx file')) v(f, n, e)"""


QUERIES = {
    "crawl_files": (crawl_files, CRAWLED),
    "filter_files": (filter_files, FILTERED),
    "file_info": (file_info, INFO),
    "read_text": (read_text, READ),
    "store_chunks": (store_chunks, STORED),
    "collection_open": (collection_open, OPENED),
    "collection_count": (collection_count, f"SELECT count(*) AS count FROM {CHUNKS}"),
    "stream_index": (stream_index, STREAMED),
    "index_jobs": (index_jobs, JOBS),
    "index_directory": (index_directory, INDEXED),
}
