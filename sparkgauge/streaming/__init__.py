"""Streaming forms of the bucketed series: an extension of ours, batch being the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)


def bucketed(events: DataFrame, ts: str = "ts", width: str = "7 days", late: str = "1 day", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Tumbling buckets with a watermark: a bucket is final once its end lies ``late`` behind."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, width, startTime="4 days").alias("bucket"), *keys)
        .agg(F.count("*").alias("items"), F.sum(F.col(value).cast("decimal(18,4)")).alias("hours"))
        .select(F.col("bucket.start").alias("since"), F.col("bucket.end").alias("until"), *keys, "items", "hours")
    )


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day", key: str = "user_id") -> DataFrame:
    """Runs of one key's events without a gap."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        events.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("s"), key)
        .agg(F.count("*").alias("items"))
        .select(key, F.col("s.start").alias("since"), F.col("s.end").alias("until"), "items")
    )


def deduplicated(events: DataFrame, id_col: str = "event_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """First arrival of each id within the watermark; older state is dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])


def write(stream: DataFrame, folder: str, checkpoint: str):
    """Append final rows as Parquet; the checkpoint makes restarts exact."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
