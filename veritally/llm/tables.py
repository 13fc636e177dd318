"""Tables that an operator writes and reads again, in the folder that the cluster shares.

A written table cuts the lineage and survives the loss of an executor, and what is read from
it has no partitioning that Spark would rely on, so that skewed joins on it can be split.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs on one machine alone, a new local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        path = getattr(spark, "_veritally_dir", None) or f"file://{tempfile.mkdtemp(prefix='spark-veritally-')}"
        spark._veritally_dir = path
    return path.rstrip("/")


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder as Parquet and read it again; deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    back = spark.read.schema(df.schema).parquet(path)
    back._veritally_path = path
    return back


def drop(*tables: DataFrame | None) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:  # None is no table
        path = getattr(t, "_veritally_path", None)
        if path:
            spark = t.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def free(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark deletes them when the driver's garbage is collected, which it may not do for long."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def settings(spark: SparkSession, **values: str):
    """SQL settings for the actions within."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def bloom_filters(spark: SparkSession):
    """Let Spark keep rows without a partner out of a shuffle, by a Bloom filter of a small side's keys.

    Spark sizes the filter, and leaves it out for a large side. The small side needs a predicate.
    """
    pre = "spark__sql__optimizer__runtime__bloomFilter__"
    return settings(spark, **{f"{pre}enabled": "true", f"{pre}applicationSideScanSizeThreshold": "1b", f"{pre}creationSideThreshold": "256MB"})


def marked(df: DataFrame, name: str) -> DataFrame:
    """df, materialised, with a predicate that is true of all its rows: a small side for ``bloom_filters``.

    It is a comparison, and of a number: Spark makes a flag of one with ``true``, and sees none that selects rows in that.
    """
    table = materialise(df.withColumn("_marked", F.lit(1)), name)
    out = table.where(F.col("_marked") > 0).drop("_marked")
    out._veritally_path = table._veritally_path
    return out


def only_ids(docs: DataFrame, ids: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Rows of docs whose doc_id is in ids (doc_id, unique), by a semi join, materialised."""
    wanted = marked(ids.select("doc_id"), f"{name}-ids")
    with bloom_filters(docs.sparkSession):
        out = materialise(docs.select(*columns).join(wanted, "doc_id", "left_semi"), name)
    drop(wanted)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
