"""Corpus preparation, stage by stage: quality rules, near-duplicates, decontamination, secrets, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import mark, materialise, release
from loomtext.llm.decontam import drop_contaminated
from loomtext.llm.near_dups import keep_one
from loomtext.llm.piece_codec import encode
from loomtext.llm.quality import keep_good
from loomtext.llm.secrets import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), as it is."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, as they are."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are masked, and n_chars follows."""
    return mask_secrets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token_ids, n_tokens and round_trip."""
    return encode(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("secret_scan", secrets), ("piece_encoding", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back for the next, and what a
    stage wrote on its way is deleted then."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, at = materialise(docs)
            release(spark, since, at)
    return docs
