"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import chat_format, decontam, langid, licences, line_dedup, media_chunks, merkle, near_dup, packing, prefix_trie, quality, token_output, toxicity
from veritally.llm.tables import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_content_defined_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.chunked_media(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output.token_blocks(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    more = spark.sql(f"select * from values (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) as t(conv_id, turn, role, text)")
    return chat_format.formatted_chats(rows.unionByName(more)).drop("layout")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_content_defined_media": op3_content_defined_media,
    "op4_license_scan": op4_license_scan,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_token_blocks": op6_token_blocks,
    "op7_toxicity": op7_toxicity,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_chat_format": op12_chat_format,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": licences.ORACLE_SQL,
    "op5_benchmark_decontamination": decontam.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_chat_format": chat_format.oracle_sql(),
    "op13_merkle_manifest": merkle.oracle_sql(),
}
