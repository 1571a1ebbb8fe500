"""Schedules that fire once for each slot, however often a batch of ticks is run.

A slot is the stretch of time between two firings of a schedule. Each micro-batch enqueues the slots that its ticks are
in and that no other batch has enqueued, and writes them to its own folder of the log: a batch that is run again after a
failure finds its old folder, leaves it out of account and replaces it with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..sources.tables import stream

#: Schedules that are sent to every task.
MAX_SCHEDULES = 10_000

_SLOT = "schedule_id long, slot long, fired_at timestamp, batch long"


def slots(ticks: DataFrame, schedules: DataFrame) -> DataFrame:
    """schedule_id, slot, fired_at: the slots that ticks (at) are in, with their first tick.

    schedules: schedule_id, start (timestamp), every (seconds), enabled. A schedule has slots from its start on; one
    that is not enabled, or whose period is not positive, never fires. Ticks are first counted down to one a minute, so
    many ticks meet few schedules.
    """
    minutes = ticks.filter("at is not null").groupBy(F.date_trunc("minute", "at").alias("minute")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    own = schedules.filter("enabled and every > 0 and start is not null").select("schedule_id", F.unix_micros("start").alias("start"), (F.col("every").cast("long") * 1_000_000).alias("every"))
    if own.count() > MAX_SCHEDULES:
        raise ValueError(f"more than {MAX_SCHEDULES} schedules: take them in several logs")
    met = minutes.join(F.broadcast(own), F.unix_micros("last") >= F.col("start"))  # schedules are few: each is asked at every minute
    at = F.greatest(F.unix_micros("first"), F.col("start"))
    first, last = F.floor((at - F.col("start")) / F.col("every")), F.floor((F.unix_micros("last") - F.col("start")) / F.col("every"))
    # a minute may hold several slots of a short period: each that has a tick is found below
    short = met.filter(first != last).select("schedule_id", "start", "every", "minute")
    inside = short.join(ticks.select(F.date_trunc("minute", "at").alias("minute"), "at"), "minute").filter(F.unix_micros("at") >= F.col("start")).select("schedule_id", F.floor((F.unix_micros("at") - F.col("start")) / F.col("every")).alias("slot"), "at")
    # where the first tick came before the start, the slot's own first tick is looked up as well
    early = met.filter((first == last) & (F.unix_micros("first") < F.col("start"))).select("schedule_id", "start", "every", "minute")
    looked = early.join(ticks.select(F.date_trunc("minute", "at").alias("minute"), "at"), "minute").filter(F.unix_micros("at") >= F.col("start")).select("schedule_id", F.floor((F.unix_micros("at") - F.col("start")) / F.col("every")).alias("slot"), "at")
    whole = met.filter((first == last) & (F.unix_micros("first") >= F.col("start"))).select("schedule_id", first.alias("slot"), F.col("first").alias("at"))
    return whole.union(inside).union(looked).groupBy("schedule_id", "slot").agg(F.min("at").alias("fired_at"))


def enqueue(batch: DataFrame, number: int, schedules: DataFrame, log: str) -> None:
    """Enqueue the slots of a batch of ticks (at) that are not in other batches' folders of the log."""
    spark = batch.sparkSession
    earlier = enqueued(spark, log).filter(F.col("batch") != number).select("schedule_id", "slot")
    due = slots(batch, schedules).join(earlier, ["schedule_id", "slot"], "left_anti")
    due.write.mode("overwrite").parquet(f"{log}/batch={number}")


def enqueued(spark: SparkSession, log: str) -> DataFrame:
    """All slots of the log, each once."""
    return spark.read.schema(_SLOT).parquet(log)


def replayed(spark: SparkSession, path: str, at: str, schedules: DataFrame, files: int = 1000) -> DataFrame:
    """schedule_id, slot, fired_at for a table of ticks, read as a stream to its end."""
    log, state = scratch(spark, "slots"), scratch(spark, "slots-state")
    spark.createDataFrame([], _SLOT).drop("batch").write.parquet(f"{log}/batch=-1")
    ticks = stream(spark, path, files).select(F.col(at).cast("timestamp").alias("at"))
    run = ticks.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda batch, number: enqueue(batch, number, schedules, log)).start()
    run.awaitTermination()
    return enqueued(spark, log).select("schedule_id", "slot", "fired_at")
