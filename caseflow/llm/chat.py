"""Dialogues rendered once for each participant, who then speaks as the assistant.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.tables import need

# Marks around a message, and the role that speaks to all and is nobody's part.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
# A dialogue is rendered in parts of so many consecutive turn numbers.
PART_TURNS = 4096


def _safe(text: Column) -> Column:
    """Text in which nothing reads as a mark: ``<|`` is pulled apart."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _header(role: Column, speaker: Column) -> Column:
    name = _safe(F.regexp_replace(role, r"\s+", "_"))
    who = (F.when(role == speaker, F.lit("assistant")).when(role == SYSTEM, F.lit(SYSTEM))
           .otherwise(F.concat(F.lit("user name="), name)))
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def _rendered(messages: Column, speaker: Column) -> Column:
    """(header, body, trained) of every message, as ``speaker`` sees it."""
    return F.transform(messages, lambda m: F.struct(
        _header(m["role"], speaker).alias("header"),
        F.concat(_safe(m["text"]), F.lit(CLOSE + "\n")).alias("body"),
        (m["role"] == speaker).alias("trained")))


def _spans(rendered: Column, offset: Column) -> Column:
    """(start, end) in characters of the speaker's own messages, closing mark included, of
    a text that begins at ``offset``."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = F.struct(offset.cast("bigint").alias("at"), empty.alias("spans"))

    def add(state: Column, m: Column) -> Column:
        start = (state["at"] + F.length(m["header"])).cast("bigint")
        end = (start + F.length(m["body"])).cast("bigint")
        # Without the line break that parts messages.
        own = F.array(F.struct(start.alias("start"), (end - 1).alias("end")))
        spans = F.when(m["trained"], F.concat(state["spans"], own)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(rendered, zero, add, lambda state: state["spans"])


def _views(rows: DataFrame) -> DataFrame:
    """(conv_id, part, speaker, offset): each part for each participant of the whole
    dialogue, and how long that one's rendering of all earlier parts is."""
    role, text = F.col("_message.role"), F.col("_message.text")
    other = _header(role, F.lit(None).cast("string"))
    own = F.length(_header(F.lit(""), F.lit("")))
    sizes = rows.groupBy("conv_id", "part", role.alias("speaker")).agg(
        F.sum(F.length(other) + F.length(_safe(text)) + len(CLOSE + "\n")).alias("length"),
        F.sum(F.length(other) - own).alias("less"))
    parts = sizes.groupBy("conv_id", "part").agg(F.sum("length").alias("length"))
    speakers = sizes.where(F.col("speaker") != SYSTEM).select("conv_id", "speaker").distinct()
    views = speakers.join(parts, "conv_id").join(
        sizes.select("conv_id", "part", "speaker", "less"), ["conv_id", "part", "speaker"], "left")
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    before = F.sum(F.col("length") - F.coalesce("less", F.lit(0))).over(earlier)
    return views.select("conv_id", "part", "speaker", F.coalesce(before, F.lit(0)).alias("offset"))


def perspectives(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text",
                 part_turns: int = PART_TURNS) -> DataFrame:
    """One row per dialogue part and participant: the dialogue with that one as assistant.

    Participants are the roles other than ``system`` that speak. Their own messages are
    rendered as the assistant's and are what ``mask`` covers, (start, end) in characters
    from the beginning of the whole dialogue; the others speak as users under their names, and system messages stay what they are.
    Columns: ``conv_id``, ``part``, ``speaker``, ``n_turns``, ``n_own``, ``rendered``,
    ``mask``. A name's blanks become underscores, and a mark within a text is pulled apart.

    Messages are in the order of turn, role and text, those without a turn first; rows that
    repeat are rendered as often. Null texts are empty messages and null roles speak as
    ``unknown``. Rows without a conversation are each a dialogue of their own. Very long
    dialogues are cut by turn number, every ``part_turns``, so that no task gathers more
    than one part; messages without a turn are in part 0. Every part has a row for each
    participant of the dialogue, and a participant's parts, joined in their order, are its
    whole rendering. Rows of one turn number are not parted, however many they are. Other
    columns are left aside; a dialogue of system messages only has no participant and no row.
    """
    need(turns, conversation, turn, role, text)
    message = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("unknown")).alias(
        "role"), F.coalesce(text, F.lit("")).alias("text"))
    part = F.coalesce(F.floor(F.col(turn) / part_turns).cast("long"), F.lit(0)).alias("part")
    rows = turns.select(F.col(conversation).alias("conv_id"), part, message.alias("_message"))
    known = rows.where("conv_id IS NOT NULL")
    views = _views(known)
    known = known.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list("_message")).alias("_messages"))
    known = known.join(views, ["conv_id", "part"])
    alone = rows.where("conv_id IS NULL AND _message.role <> 'system'").select(
        "conv_id", "part", F.array("_message").alias("_messages"),
        F.col("_message.role").alias("speaker"), F.lit(0).cast("bigint").alias("offset"))
    rows = known.union(alone)
    rendered = _rendered(F.col("_messages"), F.col("speaker"))
    # Worked out once, as the one element of an array that is taken apart.
    views = F.transform(F.array(rendered), lambda view: F.struct(
        F.size(view).alias("n_turns"),
        F.size(F.filter(view, lambda m: m["trained"])).alias("n_own"),
        F.array_join(F.transform(view, lambda m: F.concat(m["header"], m["body"])), "").alias(
            "rendered"),
        _spans(view, F.col("offset")).alias("mask")))
    rows = rows.select("conv_id", "part", "speaker", F.inline(views))
    return rows
