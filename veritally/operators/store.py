"""Records: latest write wins, roll-ups with missing verdicts, merges of roll-ups, their headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.operators.ranges import numbered, placed
from veritally.schema import KEY
from veritally.sources.files import written

#: The rows of one document.
DOCUMENT_ROWS = 5000
VERDICT_FIELDS = ["status", "is_ai_modified", "confidence", "error"]


def latest_records(records: DataFrame, keys: list[str], order: list[str], fields: list[str] | None = None) -> DataFrame:
    """One record for each key, the last by ``order``: an aggregate, no sort and no window. Of its other columns all are kept, or ``fields``."""
    rest = [c for c in records.columns if c not in keys] if fields is None else fields
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def rebuild_summary(jobs: DataFrame, roster: DataFrame, records: DataFrame) -> DataFrame:
    """Every job with every detector of the roster (small); ``missing`` where there is no record."""
    grid = jobs.crossJoin(F.broadcast(roster.select("detector")))
    found = records.select(*KEY, "detector", *VERDICT_FIELDS)
    return grid.join(found, [*KEY, "detector"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def merge_summary(old: DataFrame, new: DataFrame, header: list[str] = ["num_images"]) -> DataFrame:  # noqa: B006
    """Verdicts in long form, old and new, by (KEY, detector).

    The new verdict wins, an error over an ok too, but ``missing`` never replaces a real one.
    Header fields come from the new side where the job is there (whichever detectors it has).
    Both sides hash alike on the job, so header and verdict need one exchange of each side.
    """
    side = lambda df, x: df.select(*KEY, "detector", F.struct(*VERDICT_FIELDS).alias(x), F.struct(*header).alias(f"{x}_head"))
    both = side(old, "was").join(side(new, "now"), [*KEY, "detector"], "full_outer")
    keep = F.col("now").isNull() | ((F.col("now.status") == "missing") & F.col("was").isNotNull() & (F.coalesce("was.status", F.lit("missing")) != "missing"))
    out = both.select(*KEY, "detector", F.when(keep, F.col("was")).otherwise(F.col("now")).alias("v"), "was_head", "now_head")
    heads = out.groupBy(*KEY).agg(F.max("now_head").alias("now_head"), F.max("was_head").alias("was_head")).select(*KEY, F.coalesce("now_head", "was_head").alias("head"))
    return out.select(*KEY, "detector", "v").join(heads, KEY).select(*KEY, "detector", "v.*", "head.*")


def same_shape(old: DataFrame, old_shape: str, new_shape: str) -> DataFrame:
    """The old side of a merge: nothing of it if it was made for another shape of job."""
    return old if old_shape == new_shape else old.limit(0)


def summary_header(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of a roll-up in long form: jobs, images (null or 0 is 1), buckets, detectors, shape."""
    jobs = rows.groupBy(*by, *[k for k in KEY if k not in by]).agg(F.max("num_images").alias("num_images"), F.bool_or(F.col("is_review")).alias("is_review"))
    heads = jobs.groupBy(*by).agg(
        F.count("*").alias("num_jobs"), F.sum(F.coalesce(F.nullif("num_images", F.lit(0)), F.lit(1))).alias("num_images"),
        F.concat_ws(",", F.sort_array(F.collect_set("bucket"))).alias("buckets"), F.when(F.bool_or("is_review"), "review").otherwise("image").alias("shape"),
    )
    models = rows.groupBy(*by).agg(F.concat_ws(",", F.sort_array(F.collect_set("detector"))).alias("models"))
    return heads.join(models, by)


def sharded(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """rows with shard, so that no (by, shard) has more than ``most`` rows, in order of ``order``.

    The rows of a document are numbered by ranges (``ranges.numbered``), so the number of shards follows what is
    counted, no document of a hot group outgrows a row, and none of them is ever in one task. by may be null.
    """
    at = numbered(placed(written(rows, "sharded"), by, order, "sharded"), by, "sharded")
    return at.withColumn("shard", F.floor(F.col("pos") / most)).drop("pos", "place", "block")


def to_documents(rows: DataFrame, by: list[str], most: int = DOCUMENT_ROWS) -> DataFrame:
    """Roll-up documents as the reader takes them: ``by``, and at most ``most`` rows with a verdict map each."""
    jobs = rows.groupBy(*by, *[k for k in KEY if k not in by]).agg(
        F.max("label").alias("label"), F.max("generator").alias("generator"), F.max("num_images").alias("num_images"),
        F.map_from_entries(F.collect_list(F.struct("detector", F.struct(*VERDICT_FIELDS)))).alias("verdicts"),
    )
    jobs = sharded(jobs, by, [k for k in KEY if k not in by], most)
    row = F.struct("bucket", "label", "generator", "num_images", F.col("ident").alias("review_id"), "verdicts")
    return jobs.groupBy(*by, "shard").agg(F.collect_list(row).alias("rows"), F.array_distinct(F.flatten(F.collect_list(F.map_keys("verdicts")))).alias("models"))


def to_bundles(records: DataFrame, by: list[str], most: int = DOCUMENT_ROWS) -> DataFrame:
    """Bundle documents as the reader takes them: model, bucket, the other columns of ``by``, and at most ``most`` records each."""
    record = F.struct(F.col("ident").alias("review_id"), "num_images", "is_ai_modified", "confidence", "error")
    return sharded(records, by, ["ident"], most).groupBy(*by, "shard").agg(F.collect_list(record).alias("results")).withColumnRenamed("detector", "model")


def to_item_arrays(items: DataFrame, by: list[str], most: int = DOCUMENT_ROWS) -> DataFrame:
    """by, and value: a JSON array of at most ``most`` items."""
    rows = sharded(items.withColumn("_text", F.to_json("item")), by, ["_text"], most)
    return rows.groupBy(*by, "shard").agg(F.to_json(F.collect_list("item")).alias("value")).drop("shard")
