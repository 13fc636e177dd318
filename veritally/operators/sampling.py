"""Stratified samples and cross-category pairs that need no giant sort and no product.

Choices follow a keyed hash, so they are the same under any partitioning. The design is that of
a seeded random draw; the rows drawn are this hash's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions.text import keyed_hash


def stratified_sample(rows: DataFrame, strata: list[str], key: str, ratio: float, seed: int, prefix: int = 2) -> DataFrame:
    """Of each stratum of n rows the k = min(n, max(1, round-half-even(n * ratio))) least hashes.

    Counts by hash prefix find the prefix where the k-th row lies; lower prefixes are kept
    whole, and only that one is ranked, so no task sorts a stratum.
    """
    rows = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))).withColumn("_p", F.substring("_h", 1, prefix))
    counts = rows.groupBy(*strata, "_p").agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*strata).orderBy("_p")
    counts = counts.withColumn("_upto", F.sum("_c").over(up)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*strata)))
    counts = counts.withColumn("_k", F.least("_n", F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(ratio)).cast("long"))))
    to = [f"_{s}" for s in strata]
    counts = counts.where("_upto - _c < _k").select(*[F.col(s).alias(t) for s, t in zip(strata, to, strict=True)], F.col("_p").alias("_cp"), (F.col("_k") - (F.col("_upto") - F.col("_c"))).alias("_left"), (F.col("_upto") <= F.col("_k")).alias("_whole"))
    same = [F.col(s).eqNullSafe(F.col(t)) for s, t in zip(strata, to, strict=True)] + [F.col("_p") == F.col("_cp")]
    chosen = rows.join(counts, same).drop(*to, "_cp")
    edge = chosen.where("not _whole").withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_p").orderBy("_h", key))).where("_r <= _left")
    names = [c for c in rows.columns if not c.startswith("_")]
    return chosen.where("_whole").select(*names).unionByName(edge.select(*names))


def pool_index(pool: DataFrame, category: str, key: str, prefix: int = 2) -> tuple[DataFrame, DataFrame]:
    """(pool with a dense ``idx`` over all rows, by category; categories with offset, n, total).

    The index of a row is the offset of its (category, hash prefix) in a small table of counts,
    plus its rank within that prefix.
    """
    pool = pool.withColumn("_h", F.md5(F.col(key))).withColumn("_p", F.substring("_h", 1, prefix))
    counts = pool.groupBy(category, "_p").agg(F.count("*").alias("_c"))
    ordered = Window.orderBy(category, "_p")  # categories times prefixes: a few thousand rows
    counts = counts.withColumn("_off", F.sum("_c").over(ordered) - F.col("_c"))
    rank = F.row_number().over(Window.partitionBy(category, "_p").orderBy("_h", key)) - 1
    indexed = pool.join(counts, [category, "_p"]).withColumn("idx", F.col("_off") + rank).drop("_h", "_p", "_c", "_off")
    cats = counts.groupBy(category).agg(F.min("_off").alias("offset"), F.sum("_c").alias("n"))
    return indexed, cats.withColumn("total", F.sum("n").over(Window.partitionBy()))


def mismatch_pairs(sample: DataFrame, pool: DataFrame, category: str, key: str, pool_key: str, seed: int) -> DataFrame:
    """Each sampled row with one row of the pool of another category, uniform and with replacement.

    r is drawn from the rows of other categories and moved past the own category's range: an
    equi-join on the index instead of a product. Rows with no other category to draw from go.
    """
    indexed, cats = pool_index(pool, category, pool_key)
    total = cats.agg(F.max("total").alias("all_n"))
    drawn = sample.join(F.broadcast(cats.drop("total")), category, "left").crossJoin(F.broadcast(total))
    drawn = drawn.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("offset", F.coalesce("offset", F.lit(0))).where("all_n > n")
    r = F.pmod(keyed_hash(F.lit(str(seed)), key), F.greatest(F.col("all_n") - F.col("n"), F.lit(1)))
    drawn = drawn.withColumn("_r", r).withColumn("idx", F.col("_r") + F.when(F.col("_r") >= F.col("offset"), F.col("n")).otherwise(0))
    names = sample.columns
    source = indexed.select(F.col("idx"), F.col(category).alias("review_source_category"), F.col(pool_key).alias("review_source_review_id"), *[c for c in indexed.columns if c not in (category, pool_key, "idx") and c not in names])
    return drawn.select(*names, "idx").join(source, "idx").drop("idx")


def mismatch_delta(matched: DataFrame, mismatched: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Both verdicts of the same image and detector: pairs, flips, and the change of the fake rate."""
    side = lambda df, x: df.select(*keys, F.col("is_ai_modified").alias(x))
    both = side(matched, "a").join(side(mismatched, "b"), keys).where("a is not null and b is not null")
    rate = lambda x: F.avg(F.col(x).cast("int"))
    return both.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(F.expr("a <> b")).alias("flips"), (rate("b") - rate("a")).alias("delta"))


def index_missing(index: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Index entries whose image is gone."""
    return index.join(images.select(*keys), keys, "left_anti")


def index_report(before: DataFrame, sampled: DataFrame, category: str) -> DataFrame:
    """Per category: images before and after sampling."""
    a = before.groupBy(category).agg(F.count("*").alias("images"))
    b = sampled.groupBy(category).agg(F.count("*").alias("sampled"))
    return a.join(b, category, "left").select(category, "images", F.coalesce("sampled", F.lit(0)).alias("sampled"))


def mismatch_report(pairs: DataFrame, category: str) -> DataFrame:
    """Per category: images with a review of another, and from how many categories these come."""
    return pairs.groupBy(category).agg(F.count("*").alias("images"), F.count_distinct("review_source_category").alias("sources"))
