"""The corpus pipeline: language ID, exact dedup, near dedup, secret redaction, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellspan.llm import exact_dedup, lang_id, near_dedup, packing, secrets
from cellspan.llm.store import new_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, no letter, or rejected by the model) go."""
    return lang_id.keep_identified(docs)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component at a similarity of 0.8 on shingles of five words, the smallest doc_id stays."""
    return near_dedup.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [("language_id", identify_language), ("exact_dedup", remove_copies), ("near_dedup", remove_near_copies), ("secret_scan", redact), ("packing", pack)]

#: Language ID, near-duplicate components and packing have no SQL form; tests hold run() against plain Python on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
