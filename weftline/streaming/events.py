"""Streaming forms of a few operators: an extension, for sources that never end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_key(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, time: str, by: list[str], size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by tumbling or sliding windows."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counts = stream.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by sessions that a gap ends."""
    counts = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def merge_edges(batch: DataFrame, path: str) -> None:
    """For foreachBatch: edge weights of a batch added to the table at ``path``, one part for each batch."""
    batch.write.mode("append").parquet(path)


def merged_edges(parts: DataFrame) -> DataFrame:
    """The edges that all parts add up to."""
    return parts.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.sum("cooccurrences").alias("cooccurrences"), F.sum("episodes").alias("episodes"))


def run_available(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, then stop."""
    result.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path).awaitTermination()
