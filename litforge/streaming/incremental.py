"""Incremental work with Structured Streaming: the reference workflow resumes from the ids it has done; here a file source with a checkpoint does so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose keys were not seen within the delay; state is bounded by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, time: str, size: str, delay: str, *groups: str, slide: str | None = None, value: str | None = None) -> DataFrame:
    """Counts, and sums of a value, by time window; late rows beyond the delay are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    aggregates = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), *groups).agg(*aggregates).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *groups, *[c for c in ("n", "total") if c == "n" or value])


def session_counts(stream: DataFrame, time: str, gap: str, delay: str, *groups: str) -> DataFrame:
    """Sessions that end after a gap."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *groups).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *groups, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there, exactly once; a later call takes up what came since."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
