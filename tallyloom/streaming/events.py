"""Filings as a stream: copies dropped, totals by day, batches that can run again (M1, M5 over time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only in local mode is there another one. What a stream leaves there
    goes when the session's process ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or "/tmp/spark-checkpoints"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream of files; times without a zone are taken in the session's, as watermarks need."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name one file; a plain path must be a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, as long as its copies come within `late`; state older than that is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_totals(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Count and sum of values by day and type; days later than `late` behind the newest event are closed."""
    cents = F.sum(F.col("value").cast("decimal(18,4)"))
    by_day = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), cents.alias("total"))
    return by_day.select(F.to_date("window.start").alias("day"), "event_type", "n", F.round(F.col("total").cast("double"), 3).alias("total"))


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    """Runs a stream over all there is now; each batch's whole result replaces the table (complete) or adds to it (append).

    A batch writes to its own folder, so one that runs again after a failure replaces what it left.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    for folder in (out, checkpoint):
        path = stream.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(stream.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(path)
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
