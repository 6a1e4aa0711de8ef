"""The contract queries ``opN_<name>``: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, language, license, minhash, mixing, quality, recordfile, search, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 0.85, five words."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), num=85, den=100, k=5)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and spans of all documents."""
    return license.scan(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all documents by a model fit on ``labels``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.grades_from_labels(_table(spark, sf_dir, "labels")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", "expected_grade", "p_top", (F.coalesce("p_top", F.lit(1.0)) >= quality.LEAST).alias("kept"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token records, written and read back."""
    vocabulary = bpe.Vocabulary.from_json(public_tokenizers.path("byte_bpe_50k.json"))
    return recordfile.token_file_digests(_table(spark, sf_dir, "documents"), vocabulary, end_id=2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those not held out."""
    return language.train_and_predict(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC archives, written and read back."""
    return warc.page_records(_table(spark, sf_dir, "pages"), least_bytes=0)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by the ranks file, and what they decode to."""
    vocabulary = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), vocabulary)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.where(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "query_id")
    return search.search(docs, asked, k=10)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_minhash_near_dedup, op2_license_scan, op3_quality_classifier, op4_token_records, op5_language_id, op6_warc, op7_byte_bpe, op8_source_mixing, op9_topk_search, op10_document_fingerprints]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op9_topk_search": search.SEARCH_SQL}
