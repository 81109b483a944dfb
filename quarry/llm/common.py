"""Helpers shared by the training-data operators: joins and numbers over skewed tables, raw text bytes, table reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.scratch import drop_stored, stored, stored_alone

__all__ = ["WORD_PATTERN", "drop_stored", "is_hot", "join_spread", "numbered", "stored", "stored_alone", "table", "utf8"]

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: A key is hot if it has more than this share of all rows, so there are at most a thousand of them, and more rows than
#: one task reads with ease.
HOT_SHARE, HOT_ROWS = 1000, 100_000


def is_hot(rows: Column, total: int) -> Column:
    """Whether a key with so many ``rows`` of ``total`` is one that a task shouldn't get as a whole."""
    return (rows * HOT_SHARE > total) & (rows > HOT_ROWS)


def join_spread(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """``left`` joined to ``right``, which has one row for each key and, in ``rows``, how many rows of ``left`` the key has.

    Keys with more than a thousandth of all ``total`` rows, a thousand at most, and over HOT_ROWS of them, are broadcast,
    so that no task gets all rows of one; the others are shuffled. Rows are taken to be narrow. The column ``rows`` is left out.
    """
    if total <= HOT_ROWS:
        return left.join(right.drop(rows), on)
    hot = is_hot(F.col(rows), total)
    common = right.filter(~hot).drop(rows)
    often = right.filter(hot).drop(rows)
    if often.isEmpty():
        return left.join(common, on)
    rest = left.join(F.broadcast(often.select(*on)), on, "left_anti")
    return left.join(F.broadcast(often), on).unionByName(rest.join(common, on))


def numbered(df: DataFrame, order: list[str], name: str, label: str) -> DataFrame:
    """``df`` sorted by range, with ``name``: the row's number from 0 in that order, whatever the partitions of ``df``.

    Rows are sorted and stored with their partition and their place in it; what goes before a partition is one count for
    each, broadcast. Rows that are equal in all of ``order`` have any order among them.
    """
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ranged.withColumn("__part", F.shiftright(place, 33)).withColumn("__nth", place.bitwiseAND((1 << 33) - 1)), label)
    counts = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    return kept.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str | Column = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")
