"""Task grids, what is left to do, and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_grid(jobs: DataFrame, *dims: DataFrame) -> DataFrame:
    """Jobs with every row of each dimension (detectors, prompt variants): small tables."""
    for d in dims:
        jobs = jobs.crossJoin(F.broadcast(d))
    return jobs


def done_tasks(records: DataFrame, keys: list[str], policy: str = "no_error") -> DataFrame:
    """Keys that need no new run: an error-free record (errors are tried again), or status ok."""
    done = F.col("error").isNull() if policy == "no_error" else F.col("status") == "ok"
    return records.where(done).select(*keys)


def pending_tasks(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The grid without what is done; only keys are shuffled on the done side."""
    return grid.join(done, keys, "left_anti")


def run_plan(jobs: DataFrame, roster: DataFrame, done: DataFrame, keys: list[str], job: list[str], by: list[str], per_image: bool = False) -> DataFrame:
    """For each of ``by``: jobs, pairs, skipped, to_run and calls (images, if each is a call) of jobs with every row of the roster.

    keys are a task's, and those of them in job (unique in jobs; by is part of it) a job's; the roster is small. The
    grid is counted and never made: what is done is summed by job, so only jobs and done tasks are shuffled.
    """
    of_roster = [k for k in keys if k not in job]
    times = roster.groupBy(*of_roster).agg(F.count("*").alias("_done"))
    have = done.select(*keys).dropna().distinct().join(F.broadcast(times), of_roster)
    images = F.coalesce("num_images", F.lit(1)) if per_image else F.lit(1)
    wanted = jobs.select(*job, images.cast("long").alias("_images"), F.lit(0).cast("long").alias("_done"))
    each = wanted.unionByName(have.select(*job, F.lit(None).cast("long").alias("_images"), "_done"))
    each = each.groupBy(*job).agg(F.max("_images").alias("_images"), F.sum("_done").alias("_done")).where("_images is not null")  # null: done, but not of these jobs
    sums = each.groupBy(*by).agg(F.count("*").alias("jobs"), F.sum("_done").alias("skipped"), F.sum("_images").alias("_images"), F.sum(F.col("_images") * F.col("_done")).alias("_spared"))
    size, left = F.col("jobs") * F.col("_size"), F.col("_images") * F.col("_size") - F.col("_spared")
    sums = sums.crossJoin(F.broadcast(roster.agg(F.count("*").alias("_size")))).where("_size > 0")
    return sums.select(*by, "jobs", size.alias("pairs"), "skipped", (size - F.col("skipped")).alias("to_run"), left.alias("calls"))


def run_progress(records: DataFrame, by: list[str]) -> DataFrame:
    """ok: no error and a verdict; all else is a fail. Where records have a label, also right, verdicts that
    agree with it, and accuracy, their share of all."""
    good = F.col("error").isNull() & F.col("is_ai_modified").isNotNull()
    counts = [F.count_if(good).alias("ok"), F.count_if(~good).alias("fail")]
    if "label" not in records.columns:
        return records.groupBy(*by).agg(*counts)
    right = good & (F.col("is_ai_modified") == (F.col("label") != "Negative"))
    return records.groupBy(*by).agg(*counts, F.count_if(right).alias("right")).withColumn("accuracy", F.try_divide("right", F.col("ok") + F.col("fail")))


def completion(expected: DataFrame, outputs: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Of the expected outputs of each of ``by``, how many are there."""
    have = outputs.select(*keys).distinct().withColumn("there", F.lit(True))
    return expected.join(have, keys, "left").groupBy(*by).agg(F.count_if(F.col("there")).alias("present"), F.count("*").alias("expected"))


def missing_values(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Expected members of a small dimension that the data lack."""
    return expected.select(key).join(present.select(key).distinct(), key, "left_anti")


def model_drift(records: DataFrame, roster: DataFrame) -> DataFrame:
    """Per detector: calls with a served model, those served by another than configured, and which."""
    rows = records.where("api_model is not null").join(F.broadcast(roster.select("detector", "model_id")), "detector")
    other = F.col("api_model") != F.col("model_id")
    return rows.groupBy("detector").agg(F.count("*").alias("calls"), F.count_if(other).alias("drifted"), F.concat_ws(",", F.sort_array(F.collect_set(F.when(other, F.col("api_model"))))).alias("served"))
