"""The queries of this package and, where SQL can say them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, classifier, decontaminate, jaccard, licenses, manifest, packing, prefix_trie, quality_rules, sharding, simhash, substrings, warc
from tidemark.llm.sql import ORACLE
from tidemark.llm.words import documents, with_package

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_duplicates(documents(spark, folder), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), tokenizer_path())


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"))
    return warc.read_records(index).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return classifier.score(docs.select("doc_id", "text", "n_chars"), model).select(
        "doc_id",
        classifier.held_out().alias("held_out"),
        "score",
        (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(documents(spark, folder)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, folder))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, folder))


def op10_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.perspectives(spark.read.parquet(f"{folder}/conversations.parquet"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verify(manifest.manifest(documents(spark, folder)))


def op13_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def _registered(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(with_package(spark), folder)


PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _registered(f)
    for f in (
        op1_substring_dedup, op2_best_fit_packing, op3_quality_rules, op4_warc, op5_quality_classifier,
        op6_sharding, op7_decontamination, op8_jaccard_join, op9_license_scan, op10_chat_formatting,
        op11_conversation_trie, op12_merkle_manifest, op13_simhash_dedup, pipeline,
    )
}

__all__ = ["ORACLE", "PLANS"]
