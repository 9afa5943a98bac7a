"""Structured Streaming over a growing folder of records: watermarked counts, sessions, and classified batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def record_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(rows: DataFrame, time: str = "ts", by: str = "event_type", late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums in event-time windows; rows later than the watermark are dropped by the engine, as asked for with `late`."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    source = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if rows.isStreaming else rows
    return source.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(rows: DataFrame, time: str = "ts", by: str = "user_id", late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    source = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if rows.isStreaming else rows
    return source.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def classify_into(rows: DataFrame, classify: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Writes each micro-batch, classified, under its batch id; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        classify(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
