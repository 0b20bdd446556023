"""Structured Streaming over an event folder: windowed usage with late data, and dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def usage_by_window(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events, users and cost per window and type; rows later than the watermark are left out."""
    kept = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return kept.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total_cost"))


def write_batches(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Each finished batch to Parquet; a batch that is run again replaces itself."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
