"""Content analysis and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import assemble, markdown, text
from quarry.queries import frames as fr
from quarry.queries.frames import WS, strip_sql


def route_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.route_parser(fr.files(spark, sf_dir)).select("path", "parser", "error")


_EXT = r"lower(regexp_extract(path, '[^/.][^/]*(\.[^./]+)$', 1))"
ROUTE = f"""SELECT path, CASE {' '.join(f"WHEN e = '{k}' THEN '{v}'" for k, v in text.PARSERS.items())} END AS parser,
  CASE WHEN e NOT IN ({', '.join(f"'{k}'" for k in text.PARSERS)}) THEN 'Unsupported file type: ' || e END AS error
  FROM (SELECT path, {_EXT} AS e FROM {fr.FILES})"""


def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.text_profile(fr.raw_texts(spark, sf_dir)).drop("text")


_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
PROFILE = f"""WITH p AS (SELECT doc_id, text, string_split_regex(text, '{_BREAK}') AS l FROM {fr.RAW_TEXTS}),
q AS (SELECT doc_id, text, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM p),
r AS (SELECT *, len(list_filter(l, lambda x: regexp_matches(x, '[^\\t\\n\\x0b\\f\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\p{{Z}}]'))) AS f FROM q)
SELECT doc_id, length(text)::INT AS total_chars, len(l)::INT AS total_lines, f::INT AS non_empty_lines, (len(l) - f)::INT AS whitespace_lines,
  len(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> ''))::INT AS words,
  len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: {strip_sql('x')} <> ''))::INT AS paragraphs FROM r"""


def line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.raw_texts(spark, sf_dir).select("doc_id", text.line_endings(F.col("text")).alias("line_endings"))


ENDINGS = f"""SELECT doc_id, CASE WHEN contains(text, chr(13) || chr(10)) THEN 'CRLF (Windows)' WHEN contains(text, chr(13)) THEN 'CR (Mac)'
  WHEN contains(text, chr(10)) THEN 'LF (Unix/Linux)' ELSE 'Unknown' END AS line_endings FROM {fr.RAW_TEXTS}"""


def file_type_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.raw_texts(spark, sf_dir).select("doc_id", F.array_join(text.file_type_hints(F.col("text")), "; ").alias("hints"))


HINTS = "SELECT doc_id, concat_ws('; ', " + ", ".join(
    f"CASE WHEN regexp_matches(lower(text), '{'|'.join(marks)}') THEN '{name}' END" for name, marks in text.HINTS
) + f") AS hints FROM {fr.RAW_TEXTS}"


def binary_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bom, binary = text.binary_flags(F.col("text"))
    return fr.raw_texts(spark, sf_dir).select("doc_id", bom.alias("has_bom"), binary.alias("is_binary"))


FLAGS = rf"""SELECT doc_id, starts_with(text, chr(65279)) AS has_bom,
  length(regexp_replace(text, '[^\p{{C}}\p{{Z}}]|{WS}', '', 'g')) > 0.3 * length(text) + 1e-9 AS is_binary FROM {fr.RAW_TEXTS}"""


def _explode(spark: SparkSession, sf_dir: str, array, *fields: str) -> DataFrame:
    rows = fr.markdown(spark, sf_dir).select("doc_id", F.posexplode(array(F.col("text"))).alias("pos", "x"))
    return rows.select("doc_id", "pos", *[F.col(f"x.{f}").alias(f) for f in fields])


def md_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explode(spark, sf_dir, markdown.headings, "level", "text", "anchor")


def anchor_sql(x: str) -> str:
    kept = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\t\n\x0b\f\r\x1c-\x20\x{{85}}\x{{a0}}\p{{Z}}-]', '', 'g')"
    return rf"regexp_replace(regexp_replace({kept}, '[-\t\n\x0b\f\r\x1c-\x20\x{{85}}\x{{a0}}\p{{Z}}]+', '-', 'g'), '^-+|-+$', '', 'g')"


HEADINGS = rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}),
    lambda x: regexp_matches(x, '^#{{1,6}}{WS}+.')) AS l FROM {fr.MARKDOWN}),
h AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM l),
t AS (SELECT doc_id, pos, length(regexp_extract(x, '^(#+)', 1)) AS level, {strip_sql(f"regexp_extract(x, '^#{{1,6}}{WS}+(.+)$', 1)")} AS text FROM h)
SELECT doc_id, pos::INT AS pos, level::INT AS level, text, {anchor_sql('text')} AS anchor FROM t"""


def md_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.table(spark, sf_dir, "documents").select("doc_id", markdown.anchor(F.concat(F.lit("- "), "text")).alias("anchor"))


ANCHOR = f"SELECT doc_id, {anchor_sql(chr(39) + '- ' + chr(39) + ' || text')} AS anchor FROM documents"


def _pairs_sql(pattern: str, first: str, second: str, change: str = "a") -> str:
    return rf"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '{pattern}', 1) AS a, regexp_extract_all(text, '{pattern}', 2) AS b FROM {fr.MARKDOWN}),
u AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS a, unnest(b) AS b FROM p)
SELECT doc_id, pos::INT AS pos, {change} AS {first}, b AS {second} FROM u"""


def md_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explode(spark, sf_dir, markdown.links, "text", "url")


LINKS = _pairs_sql(r"\[([^\]]+)\]\(([^)]+)\)", "text", "url")


def md_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explode(spark, sf_dir, markdown.images, "alt", "url")


IMAGES = _pairs_sql(r"!\[([^\]]*)\]\(([^)]+)\)", "alt", "url")


def md_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explode(spark, sf_dir, markdown.code_blocks, "language", "code")


_CODE = r"(?s)```([\p{L}\p{N}_]*)\n(.*?)\n```"
CODE = _pairs_sql(_CODE, "language", "code", "CASE WHEN a = '' THEN 'text' ELSE a END")


def md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _explode(spark, sf_dir, markdown.tables, "headers", "rows", "column_count", "row_count")
    flat = F.array_join(F.transform("rows", lambda r: F.array_join(r, "¦")), "¶")
    return rows.select("doc_id", "pos", F.array_join("headers", "¦").alias("headers"), flat.alias("cells"), "column_count", "row_count")


TABLES = rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {fr.MARKDOWN}),
b AS (SELECT doc_id, i, x, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l WHERE contains(x, '|')),
c AS (SELECT doc_id, i, g, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS n, list_transform(string_split({strip_sql('x')}, '|')[2:-2], lambda y: {strip_sql('y')}) AS cells FROM b),
t AS (SELECT doc_id, g, min(i) AS i, count(*) AS n, coalesce(min(array_to_string(cells, '¦')) FILTER (n = 1), '') AS headers, min(len(cells)) FILTER (n = 1) AS cols,
  string_agg(array_to_string(cells, '¦'), '¶' ORDER BY i) FILTER (n > 2 AND len(cells) > 0) AS rows, count(*) FILTER (n > 2 AND len(cells) > 0) AS row_n FROM c GROUP BY doc_id, g)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, CASE WHEN n < 2 THEN '' ELSE headers END AS headers, coalesce(rows, '') AS cells,
  (CASE WHEN n < 2 THEN 0 ELSE cols END)::INT AS column_count, (CASE WHEN n >= 2 THEN row_n END)::INT AS row_count FROM t"""


def md_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.structure(fr.markdown(spark, sf_dir)).select("doc_id", "heading_count", "link_count", "image_count", "code_block_count", "table_count")


STRUCTURE = rf"""SELECT doc_id,
  len(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: regexp_matches(x, '^#{{1,6}}{WS}+.')))::INT AS heading_count,
  len(regexp_extract_all(text, '\[([^\]]+)\]\(([^)]+)\)'))::INT AS link_count, len(regexp_extract_all(text, '!\[([^\]]*)\]\(([^)]+)\)'))::INT AS image_count,
  len(regexp_extract_all(text, '{_CODE}'))::INT AS code_block_count,
  len(list_filter(string_split(text, chr(10)), lambda x, i: contains(x, '|') AND (i = 1 OR NOT contains(string_split(text, chr(10))[i - 1], '|'))))::INT AS table_count
FROM {fr.MARKDOWN}"""


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


_DECODED = "replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_SINGLE = f"regexp_replace({_DECODED}, '\\n{WS}*\\n', chr(10) || chr(10), 'g')"
HTML = f"SELECT page_id, {strip_sql(_SINGLE)} AS text FROM pages"


def frontmatter_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter made of a document's fields: one list of one, one of two, one of none."""
    meta = F.create_map(
        F.lit("lang"), F.array("lang"), F.lit("tags"), F.array("source", "lang"), F.lit("none"), F.array().cast("array<string>")
    )
    out = fr.table(spark, sf_dir, "documents").select("doc_id", text.flatten_frontmatter(meta).alias("m"))
    return out.select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["tags"].alias("tags"), F.col("m")["none"].alias("none"))


FRONTMATTER = """SELECT doc_id, lang, '["' || source || '","' || lang || '"]' AS tags, '[]' AS none FROM documents"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as pages; behind them come some that failed and some that are blank."""
    turns = fr.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("number"), F.concat(F.lit(" "), "text").alias("text"), F.lit(None).cast("string").alias("failure"))
    n = F.col("conv_id") + F.col("turn")
    failed = turns.filter(n % 9 == 0).withColumns({"number": F.col("number") + 100000, "failure": F.lit("bad stream")})
    blank = turns.filter(n % 5 == 0).withColumns({"number": F.col("number") + 200000, "text": F.lit(" \n")})
    return turns.unionByName(failed).unionByName(blank)


_TURNS = "SELECT conv_id, turn, turn + 1 AS number, ' ' || text AS text, NULL::VARCHAR AS failure FROM conversations"
_PAGES = f"""({_TURNS} UNION ALL SELECT conv_id, turn, number + 100000, text, 'bad stream' FROM ({_TURNS}) WHERE (conv_id + turn) % 9 = 0
  UNION ALL SELECT conv_id, turn, number + 200000, ' ' || chr(10), NULL FROM ({_TURNS}) WHERE (conv_id + turn) % 5 = 0)"""


def page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assemble.page_profile(_pages(spark, sf_dir), "number", "text", "failure")
    return out.select("conv_id", "page_number", "text_length", "has_text", "error")


PAGES = f"""SELECT conv_id, number AS page_number, (CASE WHEN failure IS NULL THEN length(text) ELSE 0 END)::INT AS text_length,
  failure IS NULL AND {strip_sql('text')} <> '' AS has_text, failure AS error FROM {_PAGES}"""


def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.assemble_pages(_pages(spark, sf_dir), "conv_id", "number", "text", "failure")


ASSEMBLED = f"""WITH p AS (SELECT conv_id, number, failure, {strip_sql("text")} AS t FROM {_PAGES})
SELECT conv_id, coalesce(string_agg(CASE WHEN failure IS NOT NULL THEN '[Page ' || number || ' - Error extracting text: ' || failure || ']'
    WHEN t <> '' THEN '[Page ' || number || ']' || chr(10) || t END, chr(10) || chr(10) ORDER BY number), '') AS content, count(*) AS total_pages FROM p GROUP BY conv_id"""


def assemble_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as paragraphs, with a blank one behind every third."""
    rows = fr.table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 2).alias("turn"), "text")
    blank = rows.filter(F.col("turn") % 6 == 2).withColumns({"turn": F.col("turn") + 1, "text": F.lit("\t")})
    return assemble.assemble_paragraphs(rows.unionByName(blank), "conv_id", "turn", "text")


PARAGRAPHS = f"""WITH r AS (SELECT conv_id, turn * 2 AS turn, text FROM conversations), p AS (SELECT conv_id, turn, {strip_sql('text')} AS t FROM
  (SELECT * FROM r UNION ALL SELECT conv_id, turn + 1, chr(9) FROM r WHERE turn % 6 = 2))
SELECT conv_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (t <> ''), '') AS content, count(*) AS paragraph_count FROM p GROUP BY conv_id"""


def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fr.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", ((F.col("event_id") % 101) / 100).alias("confidence"))
    out = assemble.ocr_text(found, "user_id", "event_id", "event_type", "confidence")
    return out.select("user_id", "text", F.round("avg_confidence", 6).alias("avg_confidence"))


OCR = """SELECT user_id, coalesce(string_agg(event_type, ' ' ORDER BY event_id) FILTER ((event_id % 101) / 100 > 0.5), '') AS text,
  round(coalesce(avg((event_id % 101) / 100) FILTER ((event_id % 101) / 100 > 0.5), 0.0), 6) AS avg_confidence FROM events GROUP BY user_id"""


def image_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an image with and without a description and a text."""
    rows = fr.table(spark, sf_dir, "events").withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(5))))
    description = F.when(F.col("kind") % 3 == 0, F.col("event_type")).when(F.col("kind") % 3 == 1, F.lit(""))
    return rows.select("event_id", "kind", assemble.image_content(description, F.when(F.col("kind") % 2 == 0, F.col("props"))).alias("content"))


IMAGE = """SELECT event_id, kind, CASE WHEN d IS NULL AND t IS NULL THEN 'No content extracted from image' ELSE concat_ws(chr(10) || chr(10), d, t) END AS content
FROM (SELECT event_id, kind, CASE WHEN kind % 3 = 0 THEN 'Image Description: ' || event_type END AS d,
             CASE WHEN kind % 2 = 0 AND props <> '' THEN 'Extracted Text: ' || props END AS t FROM (SELECT *, unnest(range(0, 6))::INT AS kind FROM events))"""

QUERIES = {
    "route_parser": (route_parser, ROUTE),
    "text_profile": (text_profile, PROFILE),
    "line_endings": (line_endings, ENDINGS),
    "file_type_hints": (file_type_hints, HINTS),
    "binary_flags": (binary_flags, FLAGS),
    "md_headings": (md_headings, HEADINGS),
    "md_anchor": (md_anchor, ANCHOR),
    "md_links": (md_links, LINKS),
    "md_images": (md_images, IMAGES),
    "md_code_blocks": (md_code_blocks, CODE),
    "md_tables": (md_tables, TABLES),
    "md_structure": (md_structure, STRUCTURE),
    "html_to_text": (html_to_text, HTML),
    "frontmatter_flatten": (frontmatter_flatten, FRONTMATTER),
    "page_profile": (page_profile, PAGES),
    "assemble_pages": (assemble_pages, ASSEMBLED),
    "assemble_paragraphs": (assemble_paragraphs, PARAGRAPHS),
    "ocr_text": (ocr_text, OCR),
    "image_content": (image_content, IMAGE),
}
