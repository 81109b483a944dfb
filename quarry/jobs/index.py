"""The indexing job: files to chunks with vectors in a collection, and a report of every file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import base_name
from quarry.operators import chunking, embedding, markdown, metadata, reports, text
from quarry.sources import collection, files
from quarry.sources.scratch import WIDE, drop_stored, stored


#: Characters of a text above which its chunks are dealt out over all tasks before they are encoded.
LONG = 4 << 20


def chunk_files(
    docs: DataFrame, chunker_type: str = "token", size: int = chunking.CHUNK_SIZE, overlap: int = chunking.OVERLAP, encoder: embedding.Encoder | None = None, deal: bool = True
) -> DataFrame:
    """Chunks with vectors and metadata of ``docs`` (``filepath, filename, content, metadata``).

    A huge file has many chunks, so rows are dealt out by chunk over all tasks before they are encoded, unless ``deal`` is
    false: then chunks are encoded in the task that has their file, and nothing is shuffled.
    """
    make = chunking.CHUNKERS.get(chunker_type.lower(), chunking.chunk_token)
    rows = make(docs.select("filepath", "filename", F.col("content").alias("text"), F.col("metadata").alias("document_metadata")), size=size, overlap=overlap)
    rows = metadata.chunk_ids(rows)
    # The preview in the metadata is a second copy of the text: it is made when nothing is moved any more.
    rows = metadata.chunk_metadata(embedding.embed_chunks(rows.repartition("id") if deal else rows, encoder)).drop("document_metadata")
    return rows.withColumnRenamed("text", "document")


def documents_of(read: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Files as read -> ``filepath, filename, parser, route_error, failure, content, metadata``.

    Markdown is indexed without its markup; its front matter joins the metadata. Other than plain text and markdown
    must have been decoded: ``parsed`` has ``filepath, content`` of such files (as ``assemble_pages`` and its like make
    them) and may have ``metadata``; without a row there a file has failed.
    """
    routed = text.route_parser(read.withColumnRenamed("path", "filepath"), "filepath").withColumnRenamed("error", "route_error")
    marked = F.col("parser") == "md"
    head, body = markdown.front_matter(F.col("text"))
    routed = routed.withColumn("own", F.when(marked, text.flatten_frontmatter(head))).withColumn("text", F.when(marked, body).otherwise(F.col("text")))
    described = metadata.document_metadata(routed, path="filepath", text="text", size="length", encoding="encoding", own="own")
    content, meta = F.when(marked, markdown.plain(F.col("text"))).otherwise(F.col("text")), F.col("metadata")
    failure = F.when(F.col("parser").isNotNull() & content.isNull(), F.concat(F.lit("no decoded content for this "), "parser", F.lit(" file")))
    if parsed is not None:
        given = parsed.select("filepath", F.col("content").alias("__content"), _metadata(parsed).alias("__metadata"))
        described = described.join(given, "filepath", "left")
        content, meta = F.coalesce(content, "__content"), metadata.merged(F.col("metadata"), F.coalesce("__metadata", F.create_map().cast("map<string,string>")))
        failure = F.when(F.col("__content").isNull(), failure)
    return described.select("filepath", base_name(F.col("filepath")).alias("filename"), "parser", "route_error", failure.alias("failure"), content.alias("content"), meta.alias("metadata"))


def _metadata(parsed: DataFrame) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.coalesce(F.col("metadata"), none) if "metadata" in parsed.columns else none


def index_documents(docs: DataFrame, target: str, part: str | None = None, gone: DataFrame | None = None, **settings) -> DataFrame:
    """Store the chunks of ``docs`` in the collection at ``target``, as the ``part`` of that name if given; results per file.

    Texts and vectors are made once: documents are written to the shared folder until their chunks are stored, and chunks
    to the collection only. Files that fail the check are left out there. What was stored of the same files before is
    replaced, also by nothing where one fails now, and ``gone`` (``filepath``) names files whose chunks go as well.
    """
    return _index(_documents(docs), target, part, gone, **settings)


def _documents(docs: DataFrame) -> DataFrame:
    """``docs`` as written to the shared folder, with the ``size`` of their contents."""
    return stored(docs.withColumn("size", F.coalesce(F.length("content"), F.lit(0))), "documents", **WIDE)


def _index(docs: DataFrame, target: str, part: str | None = None, gone: DataFrame | None = None, **settings) -> DataFrame:
    """:func:`index_documents` of stored documents, which go when their chunks are there."""
    usable = docs.filter(F.col("parser").isNotNull() & F.col("failure").isNull())
    # Groups of the stored table without long texts are not read for them.
    chunks = chunk_files(usable.filter(F.col("size") <= LONG), deal=False, **settings).unionByName(chunk_files(usable.filter(F.col("size") > LONG), **settings))
    files_of = docs.select("filepath")
    counts = collection.store_files(chunks, target, files_of if gone is None else files_of.unionByName(gone.select("filepath")), part)
    results = stored(reports.results_of(docs, counts), "results")
    drop_stored(docs)
    drop_stored(counts)
    return results


def missing_files(spark: SparkSession, directory: str, target: str, listing: DataFrame) -> DataFrame:
    """``filepath`` of files below ``directory`` that the collection has and ``listing`` (``path``) has not."""
    below = F.col("filepath").startswith(files.full_path(spark, directory).rstrip("/") + "/")
    return collection.indexed_files(spark, target).filter(below).join(listing.select(F.col("path").alias("filepath")), "filepath", "left_anti")


def index_directory(
    spark: SparkSession, directory: str, target: str, parsed: DataFrame | None = None, recursive: bool = True, max_file_mb: float = files.MAX_FILE_MB, remove_missing: bool = False, **settings
) -> DataFrame:
    """Index all supported files below ``directory``; results per file. See :func:`documents_of` for ``parsed``, of which
    rows of text files are not read.

    A directory that is indexed again has its chunks once: those of each file are replaced. ``remove_missing`` also takes
    out what is stored of files below the directory that are no longer there.
    """
    texts, others = files.texts_and_others(spark, directory, recursive, max_file_mb)
    others = files.decoded(others.withColumn("content", F.lit(None).cast("binary")))
    # Only files that are no text are joined with ``parsed``, or the join would move all texts.
    docs = _documents(documents_of(files.decoded(texts)).unionByName(documents_of(others, parsed)))
    gone = missing_files(spark, directory, target, docs.select(F.col("filepath").alias("path"))) if remove_missing else None
    return _index(docs, target, gone=gone, **settings)


def retry_failed(results: DataFrame, target: str, parsed: DataFrame | None = None, max_file_mb: float = files.MAX_FILE_MB, **settings) -> DataFrame:
    """Read the files that failed in ``results`` again, and index them; the results of all files, the others' as they were.

    A file that is there no longer fails as one without content.
    """
    spark = results.sparkSession
    failed = results.filter(~F.col("success")).select(F.col("file_path").alias("path"))
    found = stored(files.with_details(failed), "retried")
    again = files.with_content(found.filter(files.supported(max_file_mb=max_file_mb) & files.is_text()))
    lost = found.join(again.select("path"), "path", "left_anti").withColumn("content", F.lit(None).cast("binary"))
    read = files.decoded(again.unionByName(lost))
    done = stored(index_documents(documents_of(read, parsed), target, **settings), "results")
    kept = results.join(done.select("file_path"), "file_path", "left_anti")
    return kept.unionByName(done)
