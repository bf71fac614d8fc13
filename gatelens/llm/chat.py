"""Chat formatting by perspective rotation: a dialogue is rendered once for every participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
BLOCK = 4096


def _rendered(turn: Column, speaker: Column, system: str) -> Column:
    head = (
        F.when(turn["_role"].eqNullSafe(F.lit(system)), F.lit("<|system|>\n"))
        .when(turn["_role"] == speaker, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user:"), F.coalesce(turn["_role"], F.lit("unknown")), F.lit("|>\n")))
    )
    return F.struct(
        head.alias("head"),
        F.concat(F.coalesce(turn["_text"], F.lit("")), F.lit(END)).alias("body"),
        turn["_role"].eqNullSafe(speaker).alias("own"),
    )


def rotations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    system: str = "system",
) -> DataFrame:
    """``conv, speaker, part, n_turns, n_own, rendered, mask`` for every participant of every conversation.

    ``rendered`` has the turns in order: those of ``speaker`` under ``<|assistant|>``, all others under their names, the
    system's under ``<|system|>``. ``mask`` lists start and end (code points, from 0) of what the speaker said, end mark
    included: the parts to learn from. A conversation is cut into parts of 4096 turn numbers, so that one of any length
    is spread over tasks; a participant gets every part, also those where only others speak.

    Turns of equal number follow by role, then text, null first; turns without a number are a part of their own (null).
    A turn written twice counts once. Null role: a user ``unknown`` with no perspective of its own. Null text: empty.
    Null conversation: a conversation of its own. A conversation of system turns only has no participant and no row.
    Empty input: no rows. Other columns play no part.
    """
    rows = turns.select(
        turns[conv_col].alias("_conv"),
        turns[turn_col].cast("long").alias("_turn"),
        turns[role_col].alias("_role"),
        turns[text_col].alias("_text"),
    ).withColumn("_part", F.floor(F.col("_turn") / BLOCK))
    speakers = rows.filter(F.col("_role").isNotNull() & (F.col("_role") != system)).select("_conv", F.col("_role").alias("_speaker")).distinct()
    blocks = rows.groupBy("_conv", "_part").agg(F.sort_array(F.collect_set(F.struct("_turn", "_role", "_text"))).alias("_turns"))
    seen = blocks.join(speakers, blocks["_conv"].eqNullSafe(speakers["_conv"])).drop(speakers["_conv"])
    said = seen.withColumn("_said", F.transform("_turns", lambda t: _rendered(t, F.col("_speaker"), system)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.char_length(turn["head"])
        end = begin + F.char_length(turn["body"])
        more = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"), F.when(turn["own"], F.concat(done["spans"], more)).otherwise(done["spans"]).alias("spans")
        )

    return said.select(
        F.col("_conv").alias(conv_col),
        F.col("_speaker").alias("speaker"),
        F.col("_part").alias("part"),
        F.size("_said").alias("n_turns"),
        F.size(F.filter("_said", lambda t: t["own"])).alias("n_own"),
        F.array_join(F.transform("_said", lambda t: F.concat(t["head"], t["body"])), "").alias("rendered"),
        F.aggregate("_said", start, step)["spans"].alias("mask"),
    )
