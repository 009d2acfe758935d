"""Structured Streaming forms: each gives on a stream of files what its batch form gives on the whole.

Event times without zone are cast to TIMESTAMP at the stream's edge (watermarks need
it) and back after.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from moorline.operators import ingest, keyed
from moorline.operators.timegrid import micros
from moorline.sources import feeds

KEYS = ["system_id", "station_id"]


def run_all(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there now into Parquet, and read it back."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def feed_sinks(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that validates and normalises raw feeds (keys, raw) into three tables below ``path``: rows, warnings and quarantine.

    First-entry-wins is decided inside a feed, which is one row of one batch, so the batch
    form's windows serve. Every batch writes directories of its own number, so a batch that
    runs again changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        checked = feeds.validate(batch).persist()  # parsed once, not by each table and each condition
        good, bad = feeds.split(checked)
        rows, warnings = feeds.normalise(feeds.explode_status(good, keys), keys)
        for name, df in (("rows", rows.drop("pos")), ("warnings", warnings), ("quarantine", bad.select(*keys, "raw", "issues"))):
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        checked.unpersist()

    return run


def deduplicate(stream: DataFrame, late: str = "600 seconds") -> DataFrame:
    """One row of each (system_id, observed_at, station_id), with bounded lateness."""
    return stream.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["system_id", "station_id", "observed_at"])


def hourly(stream: DataFrame, late: str = "600 seconds") -> DataFrame:
    """Completed hours' means of rows where both counts are known."""
    x = stream.where((F.col("bikes") >= 0) & (F.col("docks") >= 0)).withWatermark("observed_at", late)
    out = x.groupBy(*KEYS, F.window("observed_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("bikes").alias("sum_bikes"), F.sum("docks").alias("sum_docks"))
    return out.select(*KEYS, F.col("w.start").alias("hour_start"), "n", "sum_bikes", "sum_docks")


def merge_latest(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that folds a batch's whole snapshots into the latest-state table at ``path``, all in one plan; each batch reads the edition before it and writes its own, so a repeated batch changes nothing. Older editions are removed."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            state = spark.read.parquet(f"{path}/edition={number - 1}")
        else:
            schema = batch.select(*KEYS, "observed_at", "bikes", "docks", "flags").withColumn("is_present", F.lit(True)).withColumn("last_changed_at", F.col("observed_at")).schema
            state = spark.createDataFrame([], schema)
        ingest.fold_snapshots(state, batch).write.mode("overwrite").parquet(f"{path}/edition={number}")
        keyed.removed(spark, f"{path}/edition={number - 2}")

    return run


class Suppressor(StatefulProcessor):
    """Sends an alert of a key at most once an interval since the last sent one."""

    def __init__(self, interval_s: int) -> None:
        self.interval_us = interval_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = sorted(x for part in rows for x in part["us"].tolist())
        last = self.last.get()[0] if self.last.exists() else None
        sent = []
        for t in times:
            if last is None or t - last >= self.interval_us:
                sent.append(t)
                last = t
        if sent:
            self.last.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(sent), "us": sent}).astype({"us": "int64"})

    def close(self) -> None:
        pass


class Flow(StatefulProcessor):
    """Rentals, returns and changes over the trailing window, and minutes since the last change, at each observation of an entity.

    State: the last count, the last change, the changes still inside the window and the timer's time, all in
    one value: each call to the state store costs more than a row. An event-time timer clears an entity's state once the watermark is ``forget_min`` past its last
    observation; if it comes back later, it starts anew. Rows of one micro-batch are taken in order of observation and arrival; rows older than
    the state are archived elsewhere and do not roll it back.
    """

    def __init__(self, window_min: int, cap_min: int, forget_min: int) -> None:
        self.window_us, self.cap, self.forget_ms = window_min * 60_000_000, float(cap_min), forget_min * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "us long, bikes int, changed long, seen int, timer long, change_us array<long>, change_delta array<int>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(u), int(b)) for u, _, b in sorted((int(u), int(f), int(b)) for part in rows for u, f, b in zip(part["us"], part["fetched_us"], part["bikes"], strict=True))]
        at, bikes, changed, seen, timer, times, deltas = self.head.get() or (None, None, None, 0, None, [], [])
        kept = list(zip(times, deltas, strict=True))
        out = []
        for us, b in new:
            if at is not None and us < at:
                continue
            delta = 0 if bikes is None else b - bikes
            if delta:
                kept.append((us, delta))
                changed = us
            kept = [x for x in kept if x[0] > us - self.window_us]
            at, bikes, seen = us, b, seen + 1
            since = None if seen < 2 else self.cap if changed is None else min(self.cap, (us - changed) / 60_000_000)
            out.append((key[0], key[1], us, sum(max(-x, 0) for _, x in kept), sum(max(x, 0) for _, x in kept), len(kept), since))
        if at is not None:
            due = at // 1000 + self.forget_ms
            if due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
            self.head.update((at, bikes, changed, seen, due, [u for u, _ in kept], [x for _, x in kept]))
        yield pd.DataFrame(out, columns=["system_id", "station_id", "us", "rentals", "returns", "n_changes", "since_change_min"]).astype({"us": "int64", "rentals": "int32", "returns": "int32", "n_changes": "int32", "since_change_min": "float64"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.head.clear()
        return iter([])

    def close(self) -> None:
        pass


def with_state(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def suppress(stream: DataFrame, key: str, at: str, interval_s: int) -> DataFrame:
    x = stream.select(F.col(key).alias("key"), micros(F.col(at)).alias("us"))
    return x.groupBy("key").transformWithStateInPandas(Suppressor(interval_s), "key string, us long", "append", "none")


FORGET_MIN = 30 * 1440  #: without an observation, after which an entity's state goes


def flow(stream: DataFrame, window_min: int, cap_min: int, forget_min: int = FORGET_MIN, late: str = "600 seconds") -> DataFrame:
    """Flow at each observation. Rows older than the watermark are dropped; state is bounded by the entities of the last ``forget_min``."""
    x = stream.where("bikes <> -1").withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", late)
    x = x.select(*KEYS, "observed_at", F.unix_micros("observed_at").alias("us"), micros(F.col("fetched_at")).alias("fetched_us"), "bikes")
    return x.groupBy(*KEYS).transformWithStateInPandas(Flow(window_min, cap_min, max(forget_min, window_min, cap_min)), "system_id string, station_id string, us long, rentals int, returns int, n_changes int, since_change_min double", "append", "EventTime")
