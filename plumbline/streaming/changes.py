"""A change stream: of each key's rows those that tell something new, a heartbeat while nothing does, and its end.

Arbitrary stateful processing (transformWithState) keeps for each key what was told last and the rows that are not yet
in order; timers wake a key when the watermark passes its next row or heartbeat. A terminal row closes its key: its state
and timers are deleted, and a row that comes after it opens the key anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..session import scratch
from ..sources.tables import stream

#: Seconds without news after which a key is told to be alive.
HEARTBEAT = 15.0
_STATE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Told(StatefulProcessor):
    """What each key has told. In event time rows are told in order once the watermark has passed them; in processing time as they come."""

    def __init__(self, key: str, terminal: tuple[str, ...], heartbeat: float, event_time: bool):
        self.key, self.terminal, self.beat, self.event_time = key, terminal, int(heartbeat * 1_000_000), event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, value string")
        self.waiting = handle.getListState("waiting", "at long, number long, value string")
        self.wake = handle.getValueState("wake", "at long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # only moves the watermark
            for _ in rows:
                pass
            return
        # value and number may be null
        fresh = [(int(a), None if pd.isna(n) else int(n), None if pd.isna(v) else v) for part in rows for a, n, v in zip(part["micros"], part["number"], part["value"])]
        if self.event_time:
            if not fresh:
                return
            now, first, wake = self._now(timerValues), min(r[0] for r in fresh), self._wake()
            self.waiting.appendList(fresh)
            if min(first, wake[0] if wake else first) < now:
                yield from self._told(key, now)
            elif wake is None or first < wake[0]:  # nothing is due: what is kept is not read
                self._wake_at(first, now)
        else:
            now = self._now(timerValues)
            yield from self._told(key, now, [(now, n, v) for _, n, v in sorted(fresh, key=_in_order)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._told(key, self._now(timerValues))

    def close(self) -> None:
        pass

    def _now(self, timers) -> int:
        return 1000 * (timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs())

    def _wake(self) -> tuple | None:
        """When the key has something to tell next (microseconds), and the timer (milliseconds) that is set for it."""
        found = self.wake.get()
        return None if found is None else tuple(found)

    def _wake_at(self, at: int | None, now: int) -> None:
        """Set the key's timer anew, or delete it."""
        before, timer = self._wake(), None if at is None else max(at, now) // 1000 + 1
        if before and before[1] != timer:
            self.handle.deleteTimer(before[1])
        if at is None:
            if before:
                self.wake.clear()
            return
        if not before or before[1] != timer:
            self.handle.registerTimer(timer)
        if before != (at, timer):
            self.wake.update((at, timer))

    def _told(self, key, now: int, rows: list[tuple] | None = None) -> Iterator[pd.DataFrame]:
        """Tell what is due before now (microseconds), keep the rest and set the key's timer."""
        later: list[tuple] = []
        if rows is None:
            held = [tuple(r) for r in self.waiting.get()]
            rows, later = sorted((r for r in held if r[0] < now), key=_in_order), [r for r in held if r[0] >= now]
        found, out = self.last.get(), []
        before = last = None if found is None else tuple(found)
        for at, number, value in rows:
            out += self._beats(last, at)
            base = last and self._base(last[0], at)
            if last is None or value != last[1]:
                ends = value in self.terminal
                out.append((at, number, value, "closed" if ends else "change"))
                last = None if ends else (at, value)
            elif last:
                last = (base, last[1])
        out += self._beats(last, now)
        if last:
            last = (self._base(last[0], now), last[1])
        if last != before:
            self.last.update(last) if last else self.last.clear()
        if self.event_time:
            self.waiting.put(later) if later else self.waiting.clear()
        due = [r[0] for r in later] + ([last[0] + self.beat] if last else [])
        self._wake_at(min(due) if due else None, now)
        if out:
            at, number, value, kind = zip(*out, strict=True)
            at = pd.DatetimeIndex(np.array(at, "datetime64[us]"), tz="UTC")
            yield pd.DataFrame({self.key: [key[0]] * len(out), "at": at, "number": pd.array(number, "Int64"), "value": list(value), "kind": list(kind)})

    def _beats(self, last: tuple | None, until: int) -> list[tuple]:
        """The heartbeats after the last news and before a time."""
        return [(at, None, last[1], "heartbeat") for at in range(last[0] + self.beat, until, self.beat)] if last else []

    def _base(self, since: int, until: int) -> int:
        """From where the next heartbeat counts."""
        return since + max(0, (until - 1 - since) // self.beat) * self.beat


def _in_order(row: tuple) -> tuple:
    at, number, value = row
    return at, number is not None, number or 0, value is not None, value or ""


def change_stream(rows: DataFrame, key: str, at: str, number: str, value: str, terminal: tuple[str, ...] = (), late: str = "1 minute", heartbeat: float = HEARTBEAT, event_time: bool = True) -> DataFrame:
    """key, at, number, value, kind (change, closed, heartbeat) of a streaming DataFrame.

    A key's rows are told in the order of at and number, whatever order they come in, as long as none is later than `late`
    (rows that are, are dropped by the watermark). Rows with a null key or time are never told. With event_time off,
    rows are told as they come, with the time of the machine, which heartbeats then follow.
    """
    rows = rows.select(F.col(key).alias(key), F.col(at).cast("timestamp").alias("at"), F.col(number).cast("long").alias("number"), F.col(value).cast("string").alias("value"))
    rows = (rows.withWatermark("at", late) if event_time else rows).withColumn("micros", F.unix_micros("at")).filter("at is not null")
    schema = StructType([rows.schema[key], StructField("at", TimestampType()), StructField("number", LongType()), StructField("value", StringType()), StructField("kind", StringType())])
    told = _Told(key, terminal, heartbeat, event_time)
    return rows.groupBy(key).transformWithStateInPandas(told, outputStructType=schema, outputMode="Append", timeMode="EventTime" if event_time else "ProcessingTime")


def replayed(spark: SparkSession, path: str, key: str, at: str, number: str, value: str, terminal: tuple[str, ...] = (), heartbeat: float = HEARTBEAT, files: int = 1000) -> DataFrame:
    """The change stream of a table of files, whatever order these come in: it is read as a stream to its end, in batches of so many files.

    As nothing is known of the files' order, nothing is told until all are read: the lateness is the table's own span.
    Then a row without a key moves the watermark behind the last row. Both runs share one checkpoint.
    """
    table = spark.read.parquet(path)
    span = table.agg(F.unix_micros(F.min(F.col(at).cast("timestamp"))).alias("lo"), F.unix_micros(F.max(F.col(at).cast("timestamp"))).alias("hi")).first()
    out, state, clock = (scratch(spark, n) for n in ("changes", "changes-state", "changes-clock"))
    columns = [c for c in dict.fromkeys((key, at, number, value))]
    source = stream(spark, path, files).select(*columns)
    empty = table.select(*columns).filter(F.lit(False))
    empty.write.parquet(clock)
    both = source.union(spark.readStream.schema(empty.schema).parquet(clock))
    before = spark.conf.get(_STATE, None)
    spark.conf.set(_STATE, _ROCKSDB)  # what transformWithState needs
    try:
        lo, hi = (span["lo"] or 0), (span["hi"] or 0)
        late = (hi - lo) // 1000 + 1
        told = change_stream(both, key, at, number, value, terminal, f"{late} milliseconds", heartbeat)
        for turn in range(2):
            if turn:
                end = F.timestamp_micros(F.lit((hi // 1000 + 1 + late) * 1000))
                spark.range(1).select(*[(end if c == at else F.lit(None)).cast(empty.schema[c].dataType).alias(c) for c in columns]).write.mode("append").parquet(clock)
            told.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STATE, before) if before else spark.conf.unset(_STATE)
    return spark.read.schema(told.schema).parquet(out)
