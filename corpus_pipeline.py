"""A corpus pipeline: quality classifier, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and
rereads as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import near_duplicates, ngram_quality, packing, quality_classifier
from millrace.llm.common import drop_table, write_table
from millrace.llm.queries import held_out


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: a score of 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(docs, labels, lambda d: ~held_out(d), only=True)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and lie in their language's perplexity band."""
    return ngram_quality.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id."""
    return near_duplicates.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, and their places in sequences."""
    return packing.pack_documents(docs, 1024, "byte_bpe_50k.json", end_id=2, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("near_duplicates", deduplicate),
    ("packing", pack),
]

#: Training, graph components and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = write_table(stage(spark, docs, sf_dir), f"stage_{name}")
        if before:
            drop_table(spark, before)
        before = path
    return docs
