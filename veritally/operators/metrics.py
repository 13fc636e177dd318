"""Confusion counts in one pass, and every metric from them.

The facts are grouped once, on (mode, category, detector, bucket); partial aggregation leaves a
few thousand groups whatever the number of facts, so nothing after it is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions.verdicts import flags

GROUP = ["mode", "category", "detector"]


def multi_image_only(facts: DataFrame) -> DataFrame:
    """Modes with several images keep jobs of two images or more."""
    return facts.where(~(F.col("mode").startswith("Multi") & (F.coalesce("num_images", F.lit(0)) < 2)))


def confusion_counts(facts: DataFrame, generators: list[str], policy: str = "ran", several_images: bool = True) -> DataFrame:
    """mode, category, detector, bucket (Negative or the generator), correct, total, conf_sum, conf_n.

    policy ``ran``: all rows that ran count; an error or a null verdict is wrong; confidences
    that are NaN are left out. ``ok_only``: rows with an error don't count, a null verdict says
    real, NaN stays. Rows of other generators never count. conf_* are over correct rows.
    """
    ran, ok = flags("status", "error")
    facts = facts.where((F.col("label") == "Negative") | ((F.col("label") == "DeepFake") & F.col("generator").isin(generators)))
    if several_images:
        facts = multi_image_only(facts)
    fake = F.col("label") != "Negative"
    if policy == "ran":
        counted, right = ran, ok & F.coalesce(F.col("is_ai_modified") == fake, F.lit(False))
        sure = right & F.col("confidence").isNotNull() & ~F.isnan("confidence")
    elif policy == "ok_only":
        counted, right = ok, F.coalesce("is_ai_modified", F.lit(False)) == fake
        sure = right & F.col("confidence").isNotNull()
    else:
        raise ValueError(policy)
    rows = facts.where(counted).select(*GROUP, F.when(fake, F.col("generator")).otherwise("Negative").alias("bucket"), right.cast("long").alias("right"), F.when(sure, F.col("confidence")).alias("conf"))
    return rows.groupBy(*GROUP, "bucket").agg(F.sum("right").alias("correct"), F.count("*").alias("total"), F.sum("conf").alias("conf_sum"), F.count("conf").alias("conf_n"))


def category_metrics(counts: DataFrame, generators: list[str]) -> DataFrame:
    """One row of metrics for each mode, category and detector; undefined ones are null."""
    of = lambda c, b: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col(c))), F.lit(0))
    wide = counts.groupBy(*GROUP).agg(
        *[of(c, b).alias(f"{c}_{i}") for i, b in enumerate(["Negative", *generators]) for c in ("correct", "total", "conf_sum", "conf_n")]
    )
    n = range(1, len(generators) + 1)
    plus = lambda c: sum((F.col(f"{c}_{i}") for i in n), F.lit(0))
    wide = wide.select("*", plus("correct").alias("tp"), plus("total").alias("fakes"))
    ratio = F.try_divide
    tn, fp, tp, fn = F.col("correct_0"), F.col("total_0") - F.col("correct_0"), F.col("tp"), F.col("fakes") - F.col("tp")
    f1 = lambda t, a, b: ratio(2 * t, 2 * t + a + b)
    tnr, neg_f1, fake_f1 = ratio(tn, F.col("total_0")), f1(tn, fn, fp), f1(tp, fp, fn)
    per: list[Column] = []
    for i, g in enumerate(generators, 1):
        per += [ratio(F.col(f"correct_{i}"), F.col(f"total_{i}")).alias(f"{g}_tpr"), ratio(F.col(f"conf_sum_{i}"), F.col(f"conf_n_{i}")).alias(f"{g}_conf")]
    return wide.select(
        *GROUP, tnr.alias("neg_tnr"), ratio(tn, tn + fn).alias("neg_precision"), neg_f1.alias("neg_f1"), ratio(F.col("conf_sum_0"), F.col("conf_n_0")).alias("neg_conf"),
        *per, fake_f1.alias("overall_f1"), ((ratio(tp, F.col("fakes")) + tnr) / 2).alias("overall_bal_acc"), ratio(tn + tp, F.col("total_0") + F.col("fakes")).alias("overall_acc"), ((neg_f1 + fake_f1) / 2).alias("overall_macro_f1"),
    )


def metric_names(generators: list[str]) -> list[str]:
    return ["neg_tnr", "neg_precision", "neg_f1", "neg_conf", *[f"{g}_{m}" for g in generators for m in ("tpr", "conf")], "overall_f1", "overall_bal_acc", "overall_acc", "overall_macro_f1"]


def macro_metrics(rows: DataFrame, generators: list[str], roster: DataFrame | None = None) -> DataFrame:
    """Means over categories, each metric over the categories where it is defined.

    roster (detector, pos): every member has a row in every mode met, members without results an
    empty one, and others none.
    """
    out = rows.groupBy("mode", "detector").agg(*[F.avg(c).alias(c) for c in metric_names(generators)])
    if roster is None:
        return out
    grid = rows.select("mode").distinct().crossJoin(F.broadcast(roster))
    return grid.join(out, ["mode", "detector"], "left")


def classic_counts(items: DataFrame, config: DataFrame) -> DataFrame:
    """Counts of classic detectors in the shape of confusion_counts, mode SingleImage-NoReview.

    items: detector, category, folder, generator, item (map). config: detector, pred_field,
    fake_values, score_field; small. Every item counts. A missing prediction is the empty text,
    so right on Negative. Of the two spellings of the fake folder the first that exists for a
    detector, category and generator is read.
    """
    rows = items.join(F.broadcast(config), "detector")
    fake = F.col("folder") != "Negative"
    said = F.array_contains("fake_values", F.trim(F.coalesce(F.try_element_at("item", F.col("pred_field")), F.lit(""))))
    score = F.trim(F.try_element_at("item", F.col("score_field"))).try_cast("double")
    rows = rows.select("category", "detector", "folder", F.coalesce("generator", F.lit("Negative")).alias("bucket"), fake.alias("fake"), (said == fake).alias("right"), F.when(fake, score).otherwise(1 - score).alias("conf"))
    rank = F.when(F.col("folder") == "Deepfake", 0).otherwise(1)
    sure = F.when(F.col("right"), F.col("conf"))
    by = rows.groupBy("category", "detector", "bucket", rank.alias("spelling")).agg(F.sum(F.col("right").cast("long")).alias("correct"), F.count("*").alias("total"), F.sum(sure).alias("conf_sum"), F.count(sure).alias("conf_n"))
    one = by.groupBy("category", "detector", "bucket").agg(F.min_by(F.struct("correct", "total", "conf_sum", "conf_n"), "spelling").alias("x"))
    return one.select(F.lit("SingleImage-NoReview").alias("mode"), "category", "detector", "bucket", "x.*")
