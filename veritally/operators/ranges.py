"""Running aggregates and neighbours in a total order, without a whole group in one task.

A window over a key holds the key's rows in one task. Here rows are dealt by ranges of (keys,
order), so a hot key lies in many blocks; windows run within (keys, block), and what a block owes
to those before it comes from one small row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.sources.files import written

PART_BITS = 33  # monotonically_increasing_id counts a partition's rows in its low bits


def placed(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows, written, with block (a range of the total order) and place (ascending in it). rows come from a written table."""
    by = [*keys, *order]
    out = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    return written(out.withColumn("block", F.shiftright("place", PART_BITS)), name)


def within(keys: list[str], exclusive: bool = False) -> Window:
    return Window.partitionBy(*keys, "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)


def with_blocks(rows: DataFrame, keys: list[str], blocks: DataFrame) -> DataFrame:
    """rows with the columns of their block; keys may be null."""
    of = blocks.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "block"]], *[c for c in blocks.columns if c not in (*keys, "block")])
    same = [rows[k].eqNullSafe(of[f"_{k}"]) for k in keys] + [rows["block"] == of["_block"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return rows.join(of, cond).drop(*[f"_{k}" for k in [*keys, "block"]])


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Placed rows with pos, their number (from 0) within keys."""
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "block").agg(F.count("*").alias("_n"), F.min("place").alias("_first"))
    blocks = blocks.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    return written(with_blocks(rows, keys, blocks).withColumn("pos", F.col("place") + F.col("_shift")).drop("_shift"), name)


def max_before(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Placed rows with the greatest value of the rows before, within keys."""
    blocks = rows.groupBy(*keys, "block").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.max("_top").over(earlier)).drop("_top")
    rows = rows.withColumn(out, F.max(value).over(within(keys, exclusive=True)))
    return with_blocks(rows, keys, blocks).withColumn(out, F.greatest(out, "_before")).drop("_before")


def stack_depth(rows: DataFrame, keys: list[str], step: Column) -> DataFrame:
    """Placed rows with depth, of a stack after each row, and taken: whether a pop (step -1) found something.

    step is 1 for a push, -1 for a pop, 0 for neither; a pop of an empty stack does nothing. With s, the
    running sum, and low, its least value so far (0 at most), the depth is s - low.
    """
    rows = rows.withColumn("_s", F.sum(step).over(within(keys)))
    rows = rows.withColumn("_low", F.min("_s").over(within(keys, exclusive=True)))
    blocks = rows.groupBy(*keys, "block").agg(F.max_by("_s", "place").alias("_sum"), F.min("_s").alias("_least"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_base") + F.col("_least")).over(earlier), F.lit(0)))).drop("_sum", "_least")
    rows = with_blocks(rows, keys, blocks)
    s = F.col("_base") + F.col("_s")
    low = F.least("_floor", F.coalesce(F.col("_base") + F.col("_low"), F.lit(0)))
    return rows.withColumn("depth", s - F.least(low, s)).withColumn("taken", s >= low).drop("_s", "_low", "_base", "_floor")
