"""Readers and writers of the job's JSON, CSV and Parquet files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.schema import BUNDLE, CLASSIC_ITEMS, EDIT_META, REVIEW_META, SUMMARY


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, deleted when the driver ends. Where none is set, a local one if Spark runs on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        top = getattr(spark, "_veritally_scratch", None) or f"file://{tempfile.mkdtemp(prefix='spark-veritally-')}"
        spark._veritally_scratch = top
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet under ``scratch``, read again: cuts the lineage, survives the loss of an executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(name: str):
    """The value of a <name>=... folder of the row's file."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"/{name}=([^/]*)/", 1)


def read_summaries(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Roll-ups under path, in long form: category, mode, job columns, detector, verdict fields.

    Files lie in folders category=... and mode=...; unreadable documents are skipped. Only the
    detectors that a document lists count, each once for every job of it; one without a verdict
    has a null status.
    """
    docs = spark.read.schema(SUMMARY).option("multiLine", multi_line).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    docs = docs.select(_folder("category").alias("category"), _folder("mode").alias("mode"), "models", F.explode("rows").alias("r"))
    long = docs.select("category", "mode", "r.bucket", "r.label", "r.generator", "r.num_images", F.coalesce(F.nullif("r.review_id", F.lit("")), "r.image_rel", "r.key").alias("ident"), F.explode("models").alias("detector"), F.col("r.verdicts").alias("v"))
    v = F.try_element_at("v", F.col("detector"))
    return long.select(*[c for c in long.columns if c != "v"], v["status"].alias("status"), v["is_ai_modified"].alias("is_ai_modified"), v["confidence"].alias("confidence"), v["error"].alias("error"))


def write_summaries(documents: DataFrame, path: str) -> None:
    """One JSON document a line, in folders by category and mode."""
    documents.drop("shard").write.partitionBy("category", "mode").json(path)


def read_bundles(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Records of bundle files: detector and bucket from the header, else from the path; mode and category from
    folders (null without); records without any identity are dropped."""
    docs = spark.read.schema(BUNDLE).option("multiLine", multi_line).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/[^/]*$", 1)
    folders = [F.nullif(_folder(c), F.lit("")).alias(c) for c in ("mode", "category")]
    rows = docs.select(*folders, F.coalesce("model", name).alias("detector"), F.coalesce("bucket", _folder("bucket")).alias("bucket"), F.explode("results").alias("r"))
    ident = F.coalesce(*[F.nullif(f"r.{c}", F.lit("")) for c in ("review_id", "image_rel", "key", "image_path")])
    return rows.select("mode", "category", "detector", "bucket", ident.alias("ident"), "r.num_images", "r.is_ai_modified", "r.confidence", "r.error").where("ident is not null")


def read_classic(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Classic detectors' item arrays in folders detector=, category=, folder=, generator=."""
    lines = spark.read.option("wholetext", multi_line).option("recursiveFileLookup", True).text(path)
    items = F.explode(F.from_json("value", CLASSIC_ITEMS))
    return lines.select(*[F.nullif(_folder(c), F.lit("")).alias(c) for c in ("detector", "category", "folder", "generator")], items.alias("item"))


def _number():
    """A review's number: in its document, else its folder."""
    return F.coalesce("number", _folder("number"))


def read_review_meta(spark: SparkSession, path: str) -> DataFrame:
    """Review metadata of any of the three shapes: number, title, body (null if no field is filled)."""
    meta = spark.read.schema(REVIEW_META).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    body = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("text", "content", "review_text")])
    return meta.select(_folder("category").alias("category"), _number().alias("number"), "title", body.alias("body"))


def read_edit_meta(spark: SparkSession, path: str) -> DataFrame:
    """Edit metadata: one row per image comment, with its place in the file."""
    meta = spark.read.schema(EDIT_META).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    rows = meta.select(_folder("category").alias("category"), _number().alias("number"), F.posexplode("per_image").alias("pos", "x"))
    return rows.select("category", "number", "pos", "x.image", "x.reviewer_comment")


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """path and length of all files under path; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def export_wide(rows: DataFrame, keys: list[str], roster: list[str]) -> DataFrame:
    """One row per job with verdict columns for each detector of the roster, for spreadsheets."""
    wide = rows.groupBy(*keys).pivot("detector", roster).agg(F.max("status").alias("status"), F.max("is_ai_modified").alias("verdict"), F.max("confidence").alias("confidence"))
    return wide


def write_metric_tables(tables: DataFrame, path: str) -> None:
    """Metric tables (mode, ...) in one folder a mode. A write replaces the modes that it has, whole, and leaves the others."""
    tables.repartition("mode").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode").parquet(path)


def read_metric_tables(spark: SparkSession, path: str, schema, modes: list[str] | None = None) -> DataFrame:
    """Metric tables as they were written; of ``modes`` only those folders are read."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.where(F.col("mode").isin(modes)) if modes else rows


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(path)
