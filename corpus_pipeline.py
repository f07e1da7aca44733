"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorlake.llm import bpe, mixing, neardup, session, suffix_dedup, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("minhash_near_dedup", neardup.stage),
    ("suffix_array_dedup", suffix_dedup.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

# The stages of toxicity, near duplicates and BPE can't be said in SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = session.fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
