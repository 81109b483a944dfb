"""Input frames of the queries: the driver tables, and files, markdown and detections made of their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with a path and a file name; fifty names are shared by all directories."""
    docs = table(spark, sf_dir, "documents")
    return docs.withColumns(
        {
            "filepath": F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")),
            "filename": F.concat(F.lit("doc_"), (F.col("doc_id") % 50).cast("string"), F.lit(".txt")),
        }
    )


DOCUMENTS = "(SELECT *, '/' || source || '/' || doc_id || '.txt' AS filepath, 'doc_' || doc_id % 50 || '.txt' AS filename FROM documents)"

SUFFIXES = (".txt", ".MD", ".pdf", ".Docx", ".doc", ".jpeg", ".xyz", "", ".tar.gz", ".")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing: ``path, length, modificationTime`` with suffixes of all kinds and sizes up to twice 50 MB."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % len(SUFFIXES)).cast("int") + 1)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(50 * 1024 * 1024) + F.col("doc_id") % 3 - 1).otherwise(F.col("n_chars")).cast("long").alias("length"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id")).alias("modificationTime"),
    )


FILES = f"""(SELECT '/' || source || '/doc_' || doc_id || ([{', '.join(repr(s) for s in SUFFIXES)}])[doc_id % {len(SUFFIXES)} + 1] AS path,
  CASE WHEN doc_id % 7 = 0 THEN 52428800 + doc_id % 3 - 1 ELSE n_chars END AS length,
  make_timestamp((1700000000 + doc_id) * 1000000) AS modificationTime FROM documents)"""

_MARKDOWN = (
    "# Doc ", "@id", "\n\nSee [source](https://x.org/", "@source", ") and ![img ", "@lang", "](/img/", "@id", ".png) ![](/none.png)\n##  Über ", "@lang",
    " -- Notes!_\n```python\nx = ", "@id", "\n# in a fence\n```\n```\nplain ", "@lang", "\n```\n| a | b |\n|---|---|\n| ", "@id", " | ", "@lang", " |\n|\n\nlone | bar\n", "@text",
)
_COLUMNS = {"@id": "doc_id", "@source": "source", "@lang": "lang", "@text": "text"}


def marked(column: Callable[[str], Column] = F.col) -> Column:
    """A document's markdown, of its columns as ``column`` gives them by name."""
    return F.concat(*[column(_COLUMNS[p]).cast("string") if p in _COLUMNS else F.lit(p) for p in _MARKDOWN])


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", marked().alias("text"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


MARKDOWN = "(SELECT doc_id, " + " || ".join(_COLUMNS.get(p) or _quoted(p) for p in _MARKDOWN) + " AS text FROM documents)"


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line ends, marks and signs that the tables lack, by the rest of the id."""
    t, n = F.col("text"), F.col("doc_id") % 6
    made = (
        F.when(n == 0, F.replace(t, F.lit("\n"), F.lit("\r\n")))
        .when(n == 1, F.concat(F.lit("a\rb"), F.replace(t, F.lit("\n"), F.lit(" "))))
        .when(n == 2, F.concat(F.lit("﻿"), t))
        .when(n == 3, F.concat(t, F.lit("\x01" * 40)))
        .when(n == 4, F.concat(F.lit(" \x0b\n\n\t"), t, F.lit("\x85x  \n")))
        .otherwise(F.concat(F.lit("Warning: setting in the README, a note"), t))
    )
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))


RAW_TEXTS = """(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10))
  WHEN 1 THEN 'a' || chr(13) || 'b' || replace(text, chr(10), ' ') WHEN 2 THEN chr(65279) || text WHEN 3 THEN text || repeat(chr(1), 40)
  WHEN 4 THEN ' ' || chr(11) || chr(10) || chr(10) || chr(9) || text || chr(133) || 'x' || chr(8232) || ' ' || chr(10)
  ELSE 'Warning: setting in the README, a note' || text END AS text FROM documents)"""

#: White space for DuckDB's regular expressions.
WS = r"[\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


#: Width of the built-in encoder's vectors.
DIM = 64


def embed_sql(source: str, key: str, text: str) -> str:
    """``key, embedding`` of the built-in encoder for distinct keys; null for blank texts."""
    return f"""(WITH w AS (SELECT {key} AS k, unnest(string_split_regex(lower({text}), '{WS}+')) AS w FROM {source}),
  b AS (SELECT k, ('0x' || substr(md5(w), 1, 4))::INT % {DIM} AS b, count(*)::DOUBLE AS n FROM w WHERE w <> '' GROUP BY ALL),
  m AS (SELECT k, map(list(b), list(n)) AS m, sqrt(sum(n * n)) AS l FROM b GROUP BY k)
  SELECT k AS {key}, list_transform(range({DIM}), lambda i: coalesce(m[i::INT], 0) / l) AS embedding FROM m)"""
