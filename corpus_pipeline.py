"""The corpus pipeline: five stages from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.plans.tables import saved

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("packing", stages.packing),
]

#: Perplexity, MinHash and byte-pair encoding have no SQL form; tests hold the first four stages against brute force or their operators and the last one's rows against its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each reads what the one before wrote as Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
