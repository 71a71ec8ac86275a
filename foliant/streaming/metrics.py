"""Append-only metric logs, read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "kind string, ts timestamp, run_id string, status string, duration double, reason string"


def append(df: DataFrame, path: str) -> None:
    """Metric events as JSON lines in a folder for each kind."""
    df.write.mode("append").partitionBy("kind").json(path)


def read_stream(spark: SparkSession, path: str, *, files_at_once: int = 100) -> DataFrame:
    """Events that are still being written; how much one batch takes is bounded."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_at_once).json(path)


def running_summary(events: DataFrame, *, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and mean durations by run and window; state older than the watermark is dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "run_id")
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.round(F.avg("duration"), 6).alias("mean_duration")).select(F.col("window.start").alias("start"), "run_id", "n", "n_ok", "mean_duration")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and end; a repeated call goes on where the last one ended."""
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
