"""The opN_ queries on the test tables: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, near_duplicates, ngram_quality, packing, ppm, quality_classifier, sentencepiece_codec, token_counts, token_store, vector_search
from .common import crc32_of, drop_table, new_path, write_result


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(_documents(spark, sf_dir), "piece_bpe_32k.model", keep=["doc_id"], with_ids=False)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(_documents(spark, sf_dir), new_path(spark, "store"), "byte_bpe_50k.json", end_id=0)
    out = write_result(token_store.read_store(spark, path, with_ids=False), "store_read")
    drop_table(spark, path)
    return out


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _documents(spark, sf_dir)
    return ppm.score(df, learn_from=F.coalesce(crc32_of(df, "doc_id"), F.lit(0)) % 7 != 2)


def op4_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.assess(_documents(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.find(_documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), 1024, "byte_bpe_50k.json", end_id=2, with_ids=False)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_documents(spark, sf_dir), keep=["doc_id"]))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), "word_bpe_49k.json", limit=2048)


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vector_search.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def held_out(doc_id: F.Column) -> F.Column:
    """Ids whose labels are not learnt from; a null id counts as an empty one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 4 == 2


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    made = quality_classifier.classify(_documents(spark, sf_dir), labels, lambda d: ~held_out(d), keep=["doc_id"])
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_store": op2_token_store,
    "op3_ppm": op3_ppm,
    "op4_ngram_quality": op4_ngram_quality,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_packing": op6_packing,
    "op7_licenses": op7_licenses,
    "op8_token_counts": op8_token_counts,
    "op9_vector_search": op9_vector_search,
    "op10_quality": op10_quality,
}

#: Byte-pair merging, compression and packing have no SQL form; those queries are tested against
#: the libraries and brute force.
ORACLES: dict[str, str] = {}
