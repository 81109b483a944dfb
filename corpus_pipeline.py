"""Corpus pipeline over ``documents``.

The quality classifier takes out bad documents, exact copies go (the largest id of a group stays), of near copies the
smallest id stays, passages that repeat are cut out of the texts, and what is left is packed into sequences of
power-of-two length. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact_dedup, packing, quality, simhash, suffix_dedup
from quarry.llm.common import drop_stored, stored_alone, table

#: The stages learn a classifier and compare fingerprints: DuckDB SQL cannot express their rows.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.production_model(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.production_path(), end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("SimHash near-dedup", near_deduplication),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written and reread as the next one's input.

    A stage's own tables go when its result is written, and that goes when the next one's is; what the last stage's rows are
    read from stays.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)
