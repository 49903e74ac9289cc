"""Choosing among sources and filings, and currency as of a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fuse(candidates: DataFrame) -> DataFrame:
    """The candidate with the highest score for each (company, q_ord, field); ties to the earlier source.

    score is the priority, plus 2 with a source url, 1 with a filing date, 0.5 with flags.
    """
    score = F.col("priority") + 2 * F.col("has_url").cast("int") + F.col("has_date").cast("int") + 0.5 * F.col("has_flags").cast("int")
    best = candidates.filter(F.col("value").isNotNull()).groupBy("company", "q_ord", "field").agg(F.max_by(F.struct("value", "source", score.alias("score")), F.struct(score, -F.col("source_order"))).alias("best"))
    return best.select("company", "q_ord", "field", "best.value", "best.source", F.col("best.score").cast("double").alias("score"))


def latest_filing(filings: DataFrame, keys: list[str], number: str, time: str) -> DataFrame:
    """For each key, the number of the newest row (of one time the largest) and the largest value of all."""
    return filings.groupBy(*keys).agg(F.max_by(number, F.struct(time, number)).alias(number), F.max("value").alias("value"))


def as_of(facts: DataFrame, rates: DataFrame, days: int = 7) -> DataFrame:
    """Each fact's rate on its day or the last day before, at most `days` back.

    Every rate is offered to the days it can serve, so the join is on equal days.
    """
    offered = rates.select("currency", F.col("rate"), F.col("day").alias("rate_day"), F.explode(F.sequence(F.lit(0), F.lit(days))).alias("back")).withColumn("day", F.date_add("rate_day", F.col("back")))
    best = offered.groupBy("currency", "day").agg(F.min_by(F.struct("rate", "rate_day"), "back").alias("best"))
    return facts.join(best, ["currency", "day"], "left").select(*facts.columns, F.col("best.rate").alias("rate"), F.col("best.rate_day").alias("rate_day"))


def median_fallback(df: DataFrame) -> DataFrame:
    """A missing rate is the median of its currency's known ones (6 digits)."""
    median = df.groupBy("currency").agg(F.round(F.median("rate"), 6).alias("_median"))
    return df.join(median, "currency", "left").withColumn("rate", F.coalesce("rate", "_median")).drop("_median")
