"""Streaming extension: time-window leaderboards and counts over an event stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours", group: str = "event_type") -> DataFrame:
    """Rows and sum of value per window and group; windows close when the watermark passes them."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = e.groupBy(F.window("__ts", width), group).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), group, "n", "total")


def run_once(out: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop: the same query serves a batch run and a standing stream."""
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
