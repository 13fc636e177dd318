"""From raw documents to packed training bins, in five stages.

Each stage works on all that the one before it kept, and its decisions take effect: rejected
documents, repeated lines, near copies and leaked test items are gone for the next. What a
stage returns is written as Parquet and read again, which cuts the lineage and lets a lost
executor cost no more than its part of one stage.

Every stage needs the columns of documents; others, whatever their names, go at the first. Null
lang, source and n_chars pass as they are. A null text is an empty one, yet stays null. An empty
table gives an empty one. No text is too long. doc_id is an integer and names a document: rows
that repeat one, and rows without one, are treated as each stage says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import decontam, line_dedup, near_dup, packing, quality
from veritally.llm.tables import DOCUMENT_COLUMNS, documents, drop, materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged.

    Each row is judged by its text alone, so equal texts, repeated rows and rows without doc_id
    are judged alike. Empty texts are scored too.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.classify(docs, labels, keep=tuple(c for c in DOCUMENT_COLUMNS if c != "doc_id"))
    return scored.where("predicted = 1").select(*DOCUMENT_COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document that lost lines and has no letter left goes.

    Of linked lines the one with the least doc_id, then the first, stays. Rows that repeat a
    doc_id lose the same lines. Rows without doc_id, null texts and blank lines stay.
    """
    out = line_dedup.dedup_lines(docs.select(*DOCUMENT_COLUMNS))
    out = out.where(~((F.col("n_removed") > 0) & ~F.col("text").rlike(r"\p{L}")))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, n_chars).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (similarity from 0.8), the one with the smallest doc_id.

    Rows that repeat a doc_id are one document and stay or go together. Rows without doc_id
    and texts without a word are in no group and stay.
    """
    gone = near_dup.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of the benchmark.

    Rows that repeat a doc_id go together. Rows without doc_id are not searched and stay, as
    do null texts and those of fewer than five words.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = decontam.contaminated(docs, items).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins: shard, bin, doc_id, piece, start, n_tokens, bin_start.

    Every row is packed, whether its doc_id is repeated or null; an empty or null text is its
    end mark alone. Ties in length go by doc_id.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", leak_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return docs


#: Learnt scores and the order of best-fit have no SQL; the stages are tested by brute force.
ORACLE_SQL: str | None = None
