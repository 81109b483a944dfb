r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged into a block by
array functions, and blocks are joined into one string:

    <turn user>first text<next>second text of the same role</turn>\n<turn assistant>answer</turn>\n

Inside roles and texts a backslash is written ``\0``, ``<`` as ``\1`` and ``>`` as ``\2``, so ``<`` and ``>`` only
ever belong to the template and reading back is exact. The loss mask is the list of spans of the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

#: Turns are first gathered in parts of so many turn numbers, then parts are gathered, so no task holds more structs
#: than the conversations it has to write.
PART = 256
#: Pieces of a conversation whose places are summed up together.
SLICE = 256


def escape(c: Column) -> Column:
    for mark, code in (("\\", "\\0"), ("<", "\\1"), (">", "\\2")):
        c = F.replace(c, F.lit(mark), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for mark, code in ((">", "\\2"), ("<", "\\1"), ("\\", "\\0")):
        c = F.replace(c, F.lit(code), F.lit(mark))
    return c


def format_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans`` (array of start from 0 and length, in code points).

    Null roles and texts count as empty. Turns are sorted by number (null first), then role, then text, so repeated
    numbers have a defined order; repeated rows are all kept. A null ``conv_id`` is a conversation of its own. A
    conversation is one string, so it is written by one task, however long, in time that grows with its turns. An empty
    table gives no rows; other columns are ignored.
    """
    rows = turns.select(
        F.col(key).alias("conv_id"),
        F.floor(F.col(turn) / PART).alias("part"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    chats = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "ts"))).alias("ps"))
    chats = chats.select("conv_id", F.flatten(F.transform("ps", lambda p: p["ts"])).alias("ts"))
    ts = F.col("ts")
    n = F.size(ts)
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (ts[i]["role"] != ts[F.greatest(i - 1, F.lit(0))]["role"]))
    chats = chats.withColumn("first", first)
    at = F.col("first")

    def block(i: Column, k: Column) -> Column:
        upto = F.when(k + 1 < F.size(at), at[F.least(k + 1, F.size(at) - 1)]).otherwise(n)
        texts = F.transform(F.slice(ts, i + 1, upto - i), lambda t: escape(t["text"]))
        return F.struct(ts[i]["role"].alias("role"), escape(ts[i]["role"]).alias("name"), texts.alias("texts"))

    chats = chats.withColumn("blocks", F.transform(at, block))
    opening = lambda b: F.concat(F.lit("<turn "), b["name"], F.lit(">"))
    written = F.transform("blocks", lambda b: F.concat(opening(b), F.array_join(b["texts"], "<next>"), F.lit("</turn>\n")))
    # Every text's place: the running length of all that stands before it.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, j: F.struct(
                    F.when(j == 0, F.length(opening(b))).otherwise(len("<next>")).alias("before"),
                    F.length(t).alias("length"),
                    F.when(j == F.size(b["texts"]) - 1, len("</turn>\n")).otherwise(0).alias("after"),
                    (b["role"] == "assistant").alias("loss"),
                ),
            ),
        )
    )
    return chats.select("conv_id", F.array_join(written, "").alias("formatted"), pieces.alias("pieces")).select(
        "conv_id", "formatted", _spans(F.col("pieces")).alias("loss_spans")
    )


def _spans(pieces: Column) -> Column:
    """Spans of the pieces under the loss, with starts from running sums.

    Sums run inside slices of SLICE pieces and then over the slices, so no array of all spans so far is copied for each.
    """
    span = "array<struct<start:int,length:int>>"
    kind = f"struct<at:int,spans:{span}>"
    none = F.array().cast(span)
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / SLICE).cast("int")), lambda i: F.slice(pieces, i * SLICE + 1, SLICE))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["before"]
        more = F.concat(acc["spans"], F.array(F.struct(start.cast("int").alias("start"), p["length"].cast("int").alias("length"))))
        return F.struct((start + p["length"] + p["after"]).cast("int").alias("at"), F.when(p["loss"], more).otherwise(acc["spans"]).alias("spans")).cast(kind)

    zero = F.struct(F.lit(0).alias("at"), none.alias("spans")).cast(kind)
    inside = F.transform(slices, lambda s: F.aggregate(s, zero, step))
    befores = F.aggregate(inside, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s["at"])))
    moved = F.zip_with(inside, befores, lambda s, b: F.transform(s["spans"], lambda x: F.struct((x["start"] + b).alias("start"), x["length"].alias("length"))))
    return F.when(F.size(pieces) > 0, F.flatten(F.filter(moved, lambda m: m.isNotNull()))).otherwise(none)


def parse_chats(formatted: Column) -> Column:
    """The turns that a formatted string holds: array of ``role, text`` in order."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        name = F.substring_index(F.substring(b, len("<turn ") + 1, 1 << 30), ">", 1)
        body = F.substring(b, F.length(name) + len("<turn >") + 1, F.lit(1 << 30))
        return F.transform(F.split(body, "<next>"), lambda t: F.struct(unescape(name).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, s["start"] + 1, s["length"])), ""))


TRICKY = r"\### Assistant: </turn> ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text")
    )
    chats = format_chats(rows.unionByName(added))
    read = chats.withColumn("turns", parse_chats(F.col("formatted"))).withColumn("loss", under_loss(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 AS same,
             length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) AS escaped,
             length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS name
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(escaped + CASE WHEN same THEN 6 ELSE name + 7 + 8 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
