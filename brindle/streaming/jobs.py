"""Streaming forms of ingestion, throttling and log retention."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from brindle.operators.logs import admitted_in, newest


def incremental(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str) -> StreamingQuery:
    """Files that arrive under source are transformed and added to target. Keys that target has are left out, so a batch that is run
    again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        made = transform(batch).dropDuplicates([key])
        known = spark.read.schema(made.schema).option("ignoreMissingFiles", "true").parquet(target) if exists(spark, target) else None
        (made if known is None else made.join(known.select(key), key, "left_anti")).write.mode("append").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def retained(spark: SparkSession, source: str, schema, target: str, checkpoint: str, n: int, order: list[str]) -> StreamingQuery:
    """Appends a log and keeps its newest n rows: each batch writes a new snapshot `target/<batch>`."""

    def write(batch: DataFrame, number: int) -> None:
        before = f"{target}/{number - 1}"
        log = batch.unionByName(spark.read.parquet(before)) if exists(spark, before) else batch
        newest(log, n, order).write.mode("overwrite").parquet(f"{target}/{number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Admission(StatefulProcessor):
    """Per key, the accepted attempts that still count. Attempts of a batch are taken in order of time; one that comes in a later batch
    than a newer one is judged when it comes."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        part = pd.concat(rows).sort_values(["at", "id"])
        before = list(self.held.get()[0]) if self.held.exists() else []
        ok, held = admitted_in(part["at"].tolist(), before, self.limit, self.window)
        self.held.update((held,))
        yield pd.DataFrame({"key": [key[0]] * len(part), "id": part["id"].tolist(), "accepted": ok})

    def close(self) -> None:
        pass


class ExpiringAdmission(Admission):
    """Forgets a key as soon as the watermark has passed all that still counts for it. at: seconds; the stream's watermark is on the same time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() / 1000
        part = pd.concat(rows)
        part = part[part["at"] >= passed]  # the engine drops what is late by the batch before
        if not len(part):
            return
        yield from super().handleInputRows(key, iter([part]), timers)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held := list(self.held.get()[0]):
            self.handle.registerTimer(int((max(held) + self.window) * 1000) + 1)
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()


def throttled(attempts: DataFrame, limit: int = 10, window: float = 300.0, delay: str | None = None) -> DataFrame:
    """A stream of attempts (key, at, id) with accepted. With delay (such as `10 minutes`) an attempt that comes when the watermark has passed its time is left out, as late, and
    the state of keys without attempts that count is removed; without, nothing is late and keys stay."""
    out = "key bigint, id bigint, accepted boolean"
    if delay is None:
        return attempts.groupBy("key").transformWithStateInPandas(Admission(limit, window), out, "Append", "None")
    timed = attempts.withColumn("time", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("time", delay)
    return timed.groupBy("key").transformWithStateInPandas(ExpiringAdmission(limit, window), out, "Append", "EventTime")
