"""Multi-turn conversations: comments shown once, histories, trajectories, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions.text import filled


def first_comment_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", comment: str = "comment") -> DataFrame:
    """Turns whose comment isn't empty and wasn't shown before in its conversation."""
    w = Window.partitionBy(conv, comment)
    return turns.where(filled(comment).isNotNull()).withColumn("_first", F.min(turn).over(w)).where(F.col(turn) == F.col("_first")).drop("_first")


def turn_history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """What turn i carries: i images, i - 1 earlier turns and their length, uploads so far.

    Ids and counts only: the histories' texts together grow with the square of a conversation.
    """
    w = Window.partitionBy(conv).orderBy(turn)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    i = F.row_number().over(w)
    chars = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    return turns.select(conv, turn, i.alias("images"), (i - 1).alias("earlier"), chars.alias("earlier_chars"), (i * (i + 1) / 2).cast("long").alias("uploads"))


def verdict_trajectory(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Running verdicts of all turns but the last, with the one before and whether it flipped."""
    w = Window.partitionBy(conv).orderBy(turn)
    last = F.max(turn).over(Window.partitionBy(conv))
    rows = turns.select(conv, turn, "is_ai_modified", last.alias("_last"), F.lag("is_ai_modified").over(w).alias("previous")).where(F.col(turn) < F.col("_last"))
    return rows.select(conv, turn, "is_ai_modified", "previous", F.coalesce(F.col("is_ai_modified") != F.col("previous"), F.lit(False)).alias("flipped"))


def conversation_totals(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns, attempts, the last turn's verdict, and the first turn with an error."""
    return turns.groupBy(conv).agg(
        F.count("*").alias("turns"), F.sum("attempts").cast("long").alias("attempts"), F.max_by("is_ai_modified", turn).alias("last_verdict"),
        F.min(F.when(F.col("error").isNotNull(), F.col(turn))).alias("first_error_turn"),
    )
