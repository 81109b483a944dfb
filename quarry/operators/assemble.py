"""Documents from their parts: pages, paragraphs and recognised texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import is_blank, strip_ws

MIN_CONFIDENCE = 0.5


def page_profile(pages: DataFrame, number: str, text: str, error: str | None = None) -> DataFrame:
    """``page_number, text_length, has_text, content, error`` beside the other columns; a failed page is empty."""
    failed = F.col(error).isNotNull() if error else F.lit(False)
    content = F.when(failed, F.lit("")).otherwise(F.coalesce(F.col(text), F.lit("")))
    return pages.withColumns(
        {
            "page_number": F.col(number),
            "text_length": F.length(content),
            "has_text": ~is_blank(content),
            "content": content,
            "error": F.col(error) if error else F.lit(None).cast("string"),
        }
    )


def _assemble(parts: DataFrame, key: str, order: str, piece: Column, counted: str) -> DataFrame:
    """Non-null pieces of each document in order, joined by blank lines; all parts are counted."""
    rows = parts.select(key, F.col(order).alias("at"), piece.alias("piece"))
    whole = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))).alias("ps"), F.count(F.lit(1)).alias(counted)
    )
    return whole.select(key, F.array_join(F.transform("ps", lambda p: p["piece"]), "\n\n").alias("content"), counted)


def assemble_pages(pages: DataFrame, key: str, number: str, text: str, error: str | None = None) -> DataFrame:
    """``key, content, total_pages``: pages with text under their number; a failed page leaves a note."""
    stripped = strip_ws(F.col(text))
    label = F.col(number).cast("string")
    piece = F.when(F.length(stripped) > 0, F.concat(F.lit("[Page "), label, F.lit("]\n"), stripped))
    if error:
        note = F.concat(F.lit("[Page "), label, F.lit(" - Error extracting text: "), F.col(error), F.lit("]"))
        piece = F.when(F.col(error).isNotNull(), note).otherwise(piece)
    return _assemble(pages, key, number, piece, "total_pages")


def assemble_paragraphs(paragraphs: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``key, content, paragraph_count``."""
    stripped = strip_ws(F.col(text))
    return _assemble(paragraphs, key, order, F.when(F.length(stripped) > 0, stripped), "paragraph_count")


def ocr_text(found: DataFrame, key: str, order: str, text: str, confidence: str) -> DataFrame:
    """``key, text, avg_confidence`` of detections above the confidence; empty and 0.0 without any."""
    sure = F.col(confidence) > MIN_CONFIDENCE
    out = found.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(sure, F.struct(F.col(order).alias("at"), F.col(text).alias("t"))))).alias("ts"),
        F.coalesce(F.avg(F.when(sure, F.col(confidence))), F.lit(0.0)).alias("avg_confidence"),
    )
    return out.select(key, F.array_join(F.transform("ts", lambda x: x["t"]), " ").alias("text"), "avg_confidence")


def image_content(description: Column, text: Column) -> Column:
    """What is indexed of an image: description and text, those that there are."""
    parts = F.concat_ws(
        "\n\n",
        F.when(F.length(description) > 0, F.concat(F.lit("Image Description: "), description)),
        F.when(F.length(text) > 0, F.concat(F.lit("Extracted Text: "), text)),
    )
    return F.when(parts == "", F.lit("No content extracted from image")).otherwise(parts)
