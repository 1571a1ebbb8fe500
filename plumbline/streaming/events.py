"""Structured Streaming over events: daily facts kept up to date, and a progress log (changes.py tells each change)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import scratch
from ..sources.tables import stream


def windowed(events: DataFrame, late: str | None = None, length: str = "1 day") -> DataFrame:
    """Counts and sums of each event type in tumbling windows. Events later than `late` are dropped by the engine, and the
    state of windows that are closed by then; without it all count and all windows stay open."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    return (rows.withWatermark("at", late) if late else rows).groupBy(F.window("at", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def daily_counts(spark: SparkSession, sf_dir: str, late: str | None = None, files: int = 1000) -> DataFrame:
    """Replays events as a stream until all are read: windows that changed are handed on after each micro-batch (update mode)
    and the last count of each window is kept. Files come in any order, so a replay drops nothing as late; an empty table
    gives no rows."""
    out, state = scratch(spark, "daily"), scratch(spark, "daily-state")
    counts = windowed(stream(spark, f"{sf_dir}/events.parquet", files), late)

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    spark.createDataFrame([], counts.schema).write.mode("append").parquet(f"{out}/batch=-1")  # there may have been no batch
    rows = spark.read.schema(StructType([*counts.schema, StructField("batch", IntegerType())])).parquet(out).groupBy("w", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return rows.select(F.col("w.start").cast("date").cast("string").alias("day"), "event_type", "r.n", F.round("r.total", 6).alias("total"))


def progress_changes(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """job_id, stage, percent, at of a progress stream: a value told again within the watermark is dropped, one that returns later is told."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["job_id", "stage", "percent"])
