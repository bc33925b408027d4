"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of turns (role and text alike) of both conversations is the prompt, rendered once; each side's other
turns are its completion. In a completion only what the assistant says is learned: every segment carries a mask of 1 there
and 0 elsewhere. Segments are rows, so a conversation of any length is never gathered; `rendered` joins them to texts where
whole strings are wanted.

DataFrame expressions only. The length of the prefix is the least turn at which the sides differ, an aggregation that
combines before the shuffle.

Defined cases: turns are ordered by number; a turn given twice counts once, and different ones of one number and side all stay, in the order
of role and text, told apart by `repeat`, which counts from 1; a null role is an empty role and a null text an empty text; a side without turns gives an empty completion; pairs whose
sides are equal have empty completions; a null pair id is no pair; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHOSEN, REJECTED = "chosen", "rejected"


def opening(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


CLOSING = "<|end|>\n"


def turns_of(df: DataFrame, pair_col: str, side_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row a pair, turn and repeat: role and text of either side, null where a side has no such turn."""
    said = F.struct(F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = df.where(F.col(pair_col).isNotNull() & F.col(turn_col).isNotNull()).select(F.col(pair_col).alias("pair"), F.col(turn_col).alias("turn"), F.col(side_col).alias("side"), said.alias("said"))
    one = lambda side: F.min(F.when(F.col("side") == side, F.col("said"))).alias(side)
    distinct = rows.distinct()  # copies of a turn are combined before the shuffle
    numbered = distinct.withColumn("repeat", F.row_number().over(Window.partitionBy("pair", "side", "turn").orderBy("said")))
    return numbered.groupBy("pair", "turn", "repeat").agg(one(CHOSEN), one(REJECTED))


def segments(df: DataFrame, pair_col: str = "pair_id", side_col: str = "side", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair_col, part (prompt, chosen or rejected), turn, repeat, opening, body, mask: what the assistant says in a completion has mask 1."""
    turns = turns_of(df, pair_col, side_col, turn_col, role_col, text_col)
    differs = ~F.col(CHOSEN).eqNullSafe(F.col(REJECTED))
    first = turns.where(differs).groupBy(F.col("pair").alias("of")).agg(F.min(F.struct("turn", "repeat")).alias("first"))
    parted = turns.join(first, F.col("pair") == F.col("of"), "left")
    common = F.col("first").isNull() | (F.struct("turn", "repeat") < F.col("first"))
    pieces = F.when(common, F.array(F.struct(F.lit("prompt").alias("part"), F.col(CHOSEN).alias("said")))).otherwise(F.array(*(F.struct(F.lit(s).alias("part"), F.col(s).alias("said")) for s in (CHOSEN, REJECTED))))
    rows = parted.select("pair", "turn", "repeat", F.explode(pieces).alias("piece")).where("piece.said IS NOT NULL").select("pair", "turn", "repeat", "piece.part", "piece.said.role", "piece.said.text")
    learned = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    return rows.select(F.col("pair").alias(pair_col), "part", "turn", "repeat", opening(F.col("role")).alias("opening"), F.concat("text", F.lit(CLOSING)).alias("body"), learned.cast("int").alias("mask"))


def rendered(parts: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """pair_col, prompt, chosen, rejected, and the masked-in characters of each completion."""
    text = F.concat("opening", "body")
    ordered = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("turn", "repeat", text.alias("text"))))), lambda x: x["text"]), "").alias(part)
    learned = lambda part: F.coalesce(F.sum(F.when((F.col("part") == part) & (F.col("mask") == 1), F.char_length("body"))), F.lit(0)).cast("long").alias(f"{part}_learned")
    return parts.groupBy(pair_col).agg(ordered("prompt"), ordered(CHOSEN), ordered(REJECTED), learned(CHOSEN), learned(REJECTED))
