"""Preference formatting of conversations, with DataFrame functions only.

The turns that a chosen and a rejected conversation share from the start are rendered once, as the prompt. What follows
in each is a completion, with the character spans of it that count towards the loss: what the assistant says and its
end mark.

Nulls and edges: turns are in order of turn, role, text, nulls first, repeated rows included; a null role is rendered
as "unknown", a null text as empty, and a null equals a null when prefixes are compared; a pair with one conversation
missing has an empty prompt and an empty completion for it (has_both false); rows without a conversation, whose pair is
null, belong to no pair and give none; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def _said(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _said(t))), "")


def _spans(turns: Column) -> Column:
    """[start, end) of each assistant turn's text in the rendered turns, in characters."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_header(t))
        stop = (start + F.length(_said(t))).cast("long")
        mine = F.array(F.struct(start.cast("long").alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], mine)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def preferences(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair: prompt, and each side's completion with its loss spans.

    pair, chosen: of the input's columns, the pair's id and whether the row is of the chosen conversation.
    """
    rows = turns.where(pair.isNotNull()).select(pair.alias("pair_id"), F.coalesce(chosen, F.lit(False)).alias("side"), F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text")).alias("t"))
    # One shuffle: both sides of a pair meet in one aggregate, which leaves out the nulls of the other side.
    sides = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, least), F.slice("r", 1, least), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, F.lit(False))
    shared = sides.select("pair_id", "c", "r", F.when(first == 0, least).otherwise(first - 1).cast("int").alias("n"))
    tails = shared.select("pair_id", (F.size("c") > 0).alias("has_chosen"), (F.size("r") > 0).alias("has_rejected"), "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), F.slice("c", F.col("n") + 1, F.size("c")).alias("c"), F.slice("r", F.col("n") + 1, F.size("r")).alias("r"))
    return tails.select("pair_id", (F.col("has_chosen") & F.col("has_rejected")).alias("has_both"), F.col("n").alias("n_prompt_turns"), _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _spans(F.col("c")).alias("chosen_spans"), _render(F.col("r")).alias("rejected"), _spans(F.col("r")).alias("rejected_spans"))
