"""Global order without a window over a whole group.

A window that numbers the rows of a key holds the key in one task. Here rows are dealt by
ranges of (keys, order), so that a hot key is spread over many tasks, and get their number from
the place in their range and the counts of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm.tables import drop, materialise

#: monotonically_increasing_id counts the rows of a partition in its low 33 bits.
PART_BITS = 33


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with pos (from 0, in ``order`` within ``keys``, nulls first) and block (a range of the whole order).

    rows come from a written table, since they are read twice. No null key is allowed. Rows that
    are equal in keys and order keep any order among them, and may be parted: what they
    are must not matter, or order must hold a column that tells them apart. Rows of a key in one
    block have consecutive numbers.
    """
    by = [*keys, *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("block", F.shiftright("_place", PART_BITS)), f"{name}-placed")
    starts = placed.groupBy(*keys, "block").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(*keys, "block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    out = materialise(placed.join(starts, [*keys, "block"]).withColumn("pos", F.col("_place") + F.col("_shift")).drop("_place", "_shift"), f"{name}-ranked")
    drop(placed)
    return out
