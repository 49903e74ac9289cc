"""Writing datasets: everything, and the latest quarter alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_only(df: DataFrame, heavy: list[str] | None = None) -> DataFrame:
    """Each company's latest quarter, without the heavy columns."""
    latest = df.groupBy("company").agg(F.max("q_ord").alias("q_ord"))
    return df.drop(*(heavy or [])).join(latest, ["company", "q_ord"], "left_semi")


def last_quarters(df: DataFrame, n: int, anchor: int) -> DataFrame:
    """I4: each company's last n quarters not after the anchor; of all its quarters where none is."""
    before = F.col("q_ord") <= anchor
    marked = df.withColumn("_any", F.max(before).over(Window.partitionBy("company"))).filter(before | ~F.col("_any"))
    return marked.withColumn("_n", F.row_number().over(Window.partitionBy("company").orderBy(F.desc("q_ord")))).filter(F.col("_n") <= n).drop("_any", "_n")


def write_dataset(df: DataFrame, path: str, version: int, kind: str = "parquet") -> None:
    """Rows with the code's version, by year, so that readers prune; the output is replaced as a whole."""
    out = df.withColumn("version", F.lit(version)).withColumn("year", F.floor(F.col("q_ord") / 4).cast("int"))
    out.write.mode("overwrite").partitionBy("year").format(kind).save(path)


def current(cached: DataFrame, version: int) -> DataFrame:
    """Cached rows that this version of the code wrote."""
    return cached.filter(F.col("version") == version).drop("version", "year")
