"""The stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame each.

All but the last return the columns of `documents` that they got, so one's output
is the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, fitted on the labelled ones, doesn't reject."""
    from tallyloom.llm.toxicity import keep_clean

    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group with equal normalised texts."""
    from tallyloom.llm.exact_dedup import keep_first

    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    from tallyloom.llm.jaccard import keep_one_of_each

    return keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that stand earlier already."""
    from tallyloom.llm.suffix_array import without_repeats

    return without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a sequence."""
    from tallyloom.llm.packing import pack

    return pack(docs)
