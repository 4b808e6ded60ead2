"""The corpus pipeline: quality rules, near-duplicate join, repeated passages, secrets, packing."""

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import jaccard_join, packing, quality_rules, repeated_bytes, secret_scans
from tallyforge.llm.common import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rejected documents and without their hosts' frequent lines."""
    return quality_rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that an earlier document holds."""
    return repeated_bytes.without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret masked."""
    return secret_scans.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining texts with their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages), ("secret_scans", secrets), ("best_fit_packing", packed)]

#: Not expressible: the stages pass whole texts through hashing and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as kept:
        for _, stage in STAGES[:-1]:
            docs = kept.stored(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)  # stored by itself
