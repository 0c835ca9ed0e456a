"""A corpus from raw documents to packed sequences, as five stages that each judge what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import classifier, decontaminate, jaccard, packing, substrings
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.words import with_package
from tidemark.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of ``sf_dir``."""
    model = classifier.fit(docs, with_package(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classifier.score(docs, model, "__quality")
    return scored.filter(F.col("__quality") >= classifier.THRESHOLD).drop("__quality")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near copies."""
    with_package(spark)
    return jaccard.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id holds as well; columns keep their types."""
    with_package(spark)
    return substrings.deduplicated(docs).to(docs.schema)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, with_package(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token piece in the packed sequences."""
    with_package(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", repeats),
    ("benchmark_decontamination", leaks),
    ("best_fit_packing", packed),
]

# The classifier's scores cannot be said in SQL; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is stored in the shared folder before the next."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
