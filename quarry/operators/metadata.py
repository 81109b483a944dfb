"""Metadata that is stored with documents and chunks, as maps of strings or typed columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import suffix_of
from quarry.operators import markdown, text as texts

PREVIEW = 500


def merged(base: Column, over: Column) -> Column:
    """Both maps; keys of ``over`` win. ``over`` is looked up for every key of ``base``: let it be a column, no long expression."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def _strings(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])


def document_metadata(docs: DataFrame, path: str, text: str, size: str, encoding: str | None = None, own: str | None = None) -> DataFrame:
    """Adds ``metadata``: what all types have, and what belongs to the type of the path's suffix.

    ``own`` names a map column (front matter, page counts); its keys win over all others.
    """
    suffix = suffix_of(F.col(path))
    c = F.col(text)
    bom, binary = texts.binary_flags(c)
    # Lower-cased in a projection of its own: below a condition it would be made again for every kind of hint.
    profiled = texts.text_profile(docs, text).withColumn("__low", F.when(suffix == ".txt", F.lower(c)))
    common = {"file_path": F.col(path), "file_type": suffix, "file_size": F.col(size), "content_length": F.length(c)}
    counts = ("total_chars", "total_lines", "non_empty_lines", "whitespace_lines", "words", "paragraphs")
    plain = {
        "encoding": F.col(encoding) if encoding else F.lit("utf-8"),
        **{k: F.col(k) for k in counts},
        "line_endings": texts.line_endings(c),
        "file_type_hints": F.to_json(texts.hints_in(F.col("__low"))),
        "has_bom": bom,
        "is_binary": binary,
    }
    marked = {name: F.size(f(c)) for name, f in (
        ("headings_count", markdown.headings), ("links_count", markdown.links), ("images_count", markdown.images),
        ("code_blocks_count", markdown.code_blocks), ("tables_count", markdown.tables),
    )}
    typed = F.when(suffix == ".txt", _strings(plain)).when(suffix == ".md", _strings(marked)).otherwise(F.create_map().cast("map<string,string>"))
    # No key is in both. ``merged`` looks its second map up for every key of the first, and would make ``typed`` as often.
    whole = F.map_concat(_strings(common), typed)
    if own:
        whole = merged(whole, F.coalesce(F.col(own), F.create_map().cast("map<string,string>")))
    return profiled.withColumn("metadata", whole).drop("__low", *[k for k in counts if k not in docs.columns])


def sanitize_metadata(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Every column in a form that a collection holds, by its type.

    Strings, numbers and booleans stay. An array becomes ``name_json`` and ``name_count``, a map or struct
    ``name_json``, anything else ``name_str``. Columns of ``keep`` are left alone.
    """
    out: list[Column] = []
    plain = (T.StringType, T.NumericType, T.BooleanType, T.NullType)
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in keep or (isinstance(field.dataType, plain) and not isinstance(field.dataType, T.DecimalType)):
            out.append(c)
        elif isinstance(field.dataType, T.ArrayType):
            out += [F.to_json(c).alias(f"{field.name}_json"), F.when(c.isNotNull(), F.size(c)).alias(f"{field.name}_count")]
        elif isinstance(field.dataType, (T.MapType, T.StructType)):
            out.append(F.to_json(c).alias(f"{field.name}_json"))
        else:
            out.append(c.cast("string").alias(f"{field.name}_str"))
    return df.select(*out)


def chunk_metadata(chunks: DataFrame, text: str = "text", document: str = "document_metadata") -> DataFrame:
    """Adds ``metadata``: the chunk's place and a preview, merged with the document's map, whose keys win."""
    preview = F.when(F.length(text) > PREVIEW, F.concat(F.substring(text, 1, PREVIEW), F.lit("..."))).otherwise(F.col(text))
    base = _strings({"filename": F.col("filename"), "filepath": F.col("filepath"), "chunk_index": F.col("chunk_index"), "total_chunks": F.col("total_chunks"), "chunk_content": preview})
    none = F.create_map().cast("map<string,string>")
    return chunks.withColumn("metadata", merged(base, F.coalesce(F.col(document), none) if document in chunks.columns else none))


def chunk_ids(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``id``: file name, number and eight digits of a hash of path, number and text, so a rerun gives the same."""
    sign = F.md5(F.concat_ws("\x1f", "filepath", F.col("chunk_index").cast("string"), text))
    return chunks.withColumn("id", F.concat_ws("_", "filename", F.col("chunk_index").cast("string"), F.substring(sign, 1, 8)))
