"""Streaming forms of the block and count operators over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; ``ts`` is made a timestamp with time zone."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def session_blocks(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """``(user_id, first, last, n)``: events closer than the gap form one block; a block is final once the watermark has passed."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).select("user_id", "first", "last", "n")


def running_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``(start, event_type, n, total)`` of tumbling windows: missing-data style counters over time."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def append(stream: DataFrame, path: str, checkpoint: str, *, partition: str | None = None):
    """Start an append-only Parquet sink that stops when the input there is has been read."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.partitionBy(partition) if partition else writer).start(path)
