"""The corpus pipeline: toxicity, exact dedup, near dedup, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import stages
from tallyloom.llm.rows import checkpointed

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("exact dedup", stages.drop_exact_copies),
    ("n-gram Jaccard join", stages.drop_near_copies),
    ("suffix-array dedup", stages.cut_repeats),
    ("best-fit packing", stages.pack_sequences),
]

#: Toxicity, tokens and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, over the whole of documents; what a stage keeps is written once, and read by all steps of the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
