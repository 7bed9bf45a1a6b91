"""Hotspot counts over a stream of events: watermarked windows and idempotent weekly snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.operators.hotspot import week_id

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counts(events: DataFrame, width: str = "14 days", slide: str = "7 days", late: str = "2 days") -> DataFrame:
    """Events of each type in sliding windows; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "users")


def new_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event id once, as long as repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def write_weekly(events: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch to its ISO weeks; a batch that is run again replaces what it wrote before."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"week_id": week_id(F.to_date("ts")), "batch_id": F.lit(batch_id)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_id", "batch_id").parquet(path)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
