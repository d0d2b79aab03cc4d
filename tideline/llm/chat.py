"""Chat formatting by perspective rotation (DataFrame operations only).

For every participant of a conversation the dialogue is rendered once more: that speaker's turns
are the assistant's, all others are users with their names, and the loss mask covers the
assistant's turns alone. System turns stay system turns in every rendering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE, OWN = "<|im_start|>", "<|im_end|>", "assistant\n"
#: A rendering is stored in pieces of so many messages, so that no task holds a whole dialogue.
WINDOW_TURNS = 512
#: Range of messages without a turn number: before all others.
NO_TURN = -(2**63)


def _plain(text: Column) -> Column:
    """Text in which no control marker can be read."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(who: Column, system: Sequence[str]) -> Column:
    """Start of a message that is not the assistant's own."""
    named = F.concat(F.lit(f"{OPEN}user name="), _plain(who), F.lit("\n"))
    return F.when(who.isin(*system), F.lit(f"{OPEN}system\n")).otherwise(named)


def _body(text: Column) -> Column:
    return F.concat(_plain(text), F.lit(CLOSE))


def _cut(said: DataFrame, window_turns: int) -> DataFrame:
    """``said`` with ``_window``: how many messages of the conversation come before, div ``window_turns``.

    Messages are ranked within ranges of turn numbers, and start where the earlier ranges' counts end, so that neither
    dense nor sparse numbers make long windows or many. Equal messages have one rank, and so one window.
    """
    said = said.withColumn("_range", F.coalesce(F.floor(F.col("_turn") / window_turns).cast("long"), F.lit(NO_TURN)))
    before = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = said.groupBy("_key", "_range").agg(F.count("*").alias("_n"))
    starts = starts.select("_key", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.rank().over(W.partitionBy("_key", "_range").orderBy("_turn", "_who", "_text"))
    placed = said.withColumn("_place", place - 1).join(starts, ["_key", "_range"])
    return placed.withColumn("_window", F.expr(f"(_start + _place) div {window_turns}")).drop("_range", "_place", "_start")


def _offsets(windows: DataFrame, system: Sequence[str]) -> DataFrame:
    """Per conversation and window, ``_people``: each participant with the characters of their rendering before it.

    Works on lengths alone: all messages as others see them, and what differs for a speaker's own. It has a row
    for each participant and window, as the renderings have.
    """
    size = lambda m: F.length(_head(m["_who"], system)) + F.length(_body(m["_text"])) + 1
    total = F.aggregate("_messages", F.lit(0).cast("long"), lambda acc, m: acc + size(m))
    sizes = windows.select("_key", "_window", total.alias("_size"), F.transform("_messages", lambda m: m["_who"]).alias("_whos"))
    spoken = sizes.select("_key", "_window", F.explode("_whos").alias("who")).where(~F.col("who").isin(*system))
    own = spoken.groupBy("_key", "_window", "who").agg(F.count("*").alias("_n"))
    own = own.withColumn("_differs", F.col("_n") * (F.lit(len(OPEN + OWN)) - F.length(_head(F.col("who"), system)))).drop("_n")
    people = own.select("_key", "who").distinct()
    rows = sizes.select("_key", "_window", "_size").join(people, "_key").join(own, ["_key", "_window", "who"], "left")
    before = W.partitionBy("_key", "who").orderBy("_window").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("_size") + F.coalesce("_differs", F.lit(0))).over(before), F.lit(0)).alias("offset")
    placed = rows.select("_key", "_window", "who", offset)
    return placed.groupBy("_key", "_window").agg(F.array_sort(F.collect_list(F.struct("who", "offset"))).alias("_people"))


def rotate_perspectives(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: Sequence[str] = ("system",),
    window_turns: int = WINDOW_TURNS,
) -> DataFrame:
    """One rendering per conversation and perspective, in pieces: a row for each window of ``window_turns`` messages.

    Columns: ``conv``, ``perspective``, ``window`` (messages before it div ``window_turns``), ``n_messages``,
    ``n_trained``, ``offset`` (characters of the rendering before this piece), ``rendered`` and ``mask``
    (array of [start, end) character spans that are trained on: the body and end marker of the assistant's
    messages). Spans count from the start of the whole rendering, which is its pieces in the order of
    their windows: where it is cut changes neither texts nor masks.

    Defined results: repeated rows (equal in all four columns) count once; turns with equal numbers
    go by speaker, then text, nulls first; a null text is empty; a null or empty speaker is named
    ``unknown``; a null conversation is a conversation of its own; a null turn comes first; windows
    count repeated rows, so that one with many may hold fewer messages, and a number may be missing; a conversation with system turns only has no perspective and gives no row; control markers in
    names and texts are broken up. Other columns are ignored. A speaker who is silent in a window
    still gets that window (with an empty mask), since a dialogue's windows belong together.
    """
    said = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("null")).alias("_key"),
        F.col(conv).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.when(F.trim(F.col(speaker)) != "", F.col(speaker)).otherwise(F.lit("unknown")).alias("_who"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    windows = _cut(said, window_turns).groupBy("_key", "_window").agg(
        F.first("_conv").alias("_conv"),
        F.array_sort(F.collect_set(F.struct("_turn", "_who", "_text"))).alias("_messages"),
    )
    each = windows.join(_offsets(windows, system), ["_key", "_window"]).select(
        "_conv", "_window", "_messages", F.explode("_people").alias("_p")
    )
    each = each.select("_conv", "_window", "_messages", F.col("_p.who").alias("perspective"), F.col("_p.offset").alias("offset"))

    def segment(m: Column) -> Column:
        own = m["_who"] == F.col("perspective")
        head = F.when(own & ~m["_who"].isin(*system), F.lit(OPEN + OWN)).otherwise(_head(m["_who"], system))
        return F.struct(head.alias("head"), _body(m["_text"]).alias("body"), own.alias("own"))

    each = each.withColumn("_parts", F.transform("_messages", segment))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def walk(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(
            (end + 1).alias("at"),
            F.when(p["own"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"),
        )

    walked = F.aggregate("_parts", F.struct(F.col("offset").alias("at"), empty.alias("mask")), walk)
    return each.select(
        F.col("_conv").alias(conv),
        "perspective",
        F.col("_window").alias("window"),
        F.size("_messages").cast("long").alias("n_messages"),
        F.size(F.filter("_parts", lambda p: p["own"])).cast("long").alias("n_trained"),
        "offset",
        F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias(
            "rendered"
        ),
        walked["mask"].alias("mask"),
    )
