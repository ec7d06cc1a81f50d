"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it as context, that reply alone under the
loss mask.  Turns behind the last reply (or a conversation without one) make a last example with nothing to
train on, so that the output holds every turn.

A turn is written ``### role: text</turn>`` and a line break.  Inside texts a backslash is written ``\\b``, ``#``
as ``\\h`` and ``<`` as ``\\l``, inside roles also ``:`` as ``\\c``; so neither ``###`` nor ``</turn>`` can come
from a text, and as every backslash begins a code of two characters, plain replacement restores it.

A conversation is gathered in one row, since its digest and its context are sequences; its examples are
exploded from there one by one and never stand in one row together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
TARGET = "assistant"

CONTROL_ID = -7
CONTROL_TEXT = "\\### Assistant: </turn> ok"


CODES = {"\\": "\\b", "#": "\\h", "<": "\\l"}
ROLE_CODES = CODES | {":": "\\c"}


def escape(text: Column, codes: dict[str, str] = CODES) -> Column:
    for char, code in codes.items():  # the backslash first
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column, codes: dict[str, str] = CODES) -> Column:
    for char, code in reversed(codes.items()):  # the backslash last
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def examples(conversations: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end`` (code points of ``text``, end exclusive; null without a target).

    Turns go by number, nulls first, ties by role and text.  Null roles and texts are empty; rows without a
    conversation id make one conversation; repeated rows are turns of their own; other columns are dropped.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role, ROLE_CODES), F.lit(COLON))
    turn = F.struct("turn", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    targets = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.get("turns", i - 1)["role"] == TARGET) | (i == F.size("turns")))
    each = whole.select("conv_id", "turns", pieces.alias("pieces"), F.posexplode(targets).alias("example", "upto"))
    placed = each.select(
        "conv_id",
        "example",
        F.array_join(F.slice("pieces", 1, F.col("upto") - 1), "").alias("context"),
        F.get("pieces", F.col("upto") - 1).alias("piece"),
        F.get("turns", F.col("upto") - 1).alias("last"),
    )
    start = F.length("context") + F.length("last.head")
    trained = F.col("last.role") == TARGET
    return placed.select(
        "conv_id",
        "example",
        F.concat("context", "piece").alias("text"),
        F.when(trained, start).alias("loss_start"),
        F.when(trained, start + F.length("last.body")).alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    pieces = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")

    def parsed(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        at = F.instr(inner, COLON)
        return F.struct(
            unescape(F.substring(inner, F.lit(1), at - 1), ROLE_CODES).alias("role"), unescape(F.substring(inner, at + len(COLON), F.length(inner))).alias("text")
        )

    return F.transform(pieces, parsed)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its examples say: turns of the longest, and all text under the loss masks in order."""
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    read = formatted.select("conv_id", "example", "text", loss.alias("loss"))
    whole = read.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))), lambda e: e["loss"]), "").alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    said = whole.select("conv_id", "loss", "formatted_chars", read_turns(F.col("text")).alias("turns"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def control_rows(spark: SparkSession) -> DataFrame:
    """The conversation that says what the template uses as control strings."""
    return spark.range(2).select(
        F.lit(CONTROL_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )


def op10(conversations: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(control_rows(conversations.sparkSession))
    return read_back(examples(rows))
