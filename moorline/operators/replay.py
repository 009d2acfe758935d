"""Ordered replay of raw feed files into rows and latest state, restartable at any point.

Files not applied yet are taken in the order of their epochs, a chunk of time at once: read, validated, normalised,
inserted once by (system_id, observed_at), and folded onto the state of the chunk before, which never goes
back in time. Every chunk writes directories of its own number below ``target`` (rows, quarantine, state) and is entered in
``done`` last; a chunk that was cut short is applied again under the same number and overwrites what it left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.operators import archive, ingest, keyed
from moorline.sources import feeds

FILE = r"(\d{10})\.json"
ROWS = ["system_id", "epoch_s", "observed_at", "station_id", "bikes", "docks", "flags", "reported_age_s"]
STATE = "system_id string, station_id string, observed_at timestamp_ntz, bikes int, docks int, flags int, is_present boolean, last_changed_at timestamp_ntz"


def pending(spark: SparkSession, files: DataFrame, target: str) -> tuple[DataFrame, int]:
    """(files that no finished chunk holds, number of the next chunk); ``files`` has system_id, epoch_s and path."""
    if not keyed.exists(spark, f"{target}/done"):
        return files, 0
    done = spark.read.schema("system_id string, epoch_s long, batch int").parquet(f"{target}/done")
    last = done.agg(F.max("batch")).first()[0]
    return files.join(done.select("system_id", "epoch_s"), ["system_id", "epoch_s"], "left_anti"), 0 if last is None else last + 1


def apply(spark: SparkSession, chunk: DataFrame, target: str, number: int) -> None:
    """One chunk of files onto the tables of the chunks before it."""
    paths = [r.path for r in chunk.select("path").collect()]  # a chunk's file names
    system = F.regexp_extract(F.col("_metadata.file_path"), r"system_id=([^/]+)", 1)
    epoch = F.regexp_extract(F.col("_metadata.file_path"), FILE, 1).cast("long")
    raw = spark.read.text(paths, wholetext=True).select(F.col("value").alias("raw"), system.alias("system_id"), epoch.alias("epoch_s"))
    good, bad = feeds.split(feeds.validate(raw))
    bad.select("system_id", "epoch_s", "issues").write.mode("overwrite").parquet(f"{target}/quarantine/batch={number}")
    observed = F.timestamp_seconds("feed.last_updated").cast("timestamp_ntz")
    # Of files of one observation the first counts, and none where an earlier chunk holds it.
    first = good.groupBy("system_id", observed.alias("observed_at")).agg(F.min("epoch_s").alias("epoch_s"))
    if number:
        before = spark.read.parquet(f"{target}/rows").where(F.col("batch") < number).select("system_id", "observed_at").distinct()
        first = first.join(before, ["system_id", "observed_at"], "left_anti")
    good = good.join(first, ["system_id", "epoch_s"])
    rows, _ = feeds.normalise(feeds.explode_status(good, ["system_id", "epoch_s", "observed_at"]), ["system_id", "epoch_s", "observed_at"])
    rows.select(*ROWS).write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
    rows = spark.read.parquet(f"{target}/rows/batch={number}")
    state = spark.read.schema(STATE).parquet(f"{target}/state/edition={number - 1}") if number else spark.createDataFrame([], STATE)
    snapshots = rows.select("system_id", "station_id", "observed_at", "bikes", "docks", "flags", F.lit(False).alias("is_anomalous"))
    ingest.fold_snapshots(state, snapshots).write.mode("overwrite").parquet(f"{target}/state/edition={number}")
    chunk.select("system_id", "epoch_s").write.mode("overwrite").parquet(f"{target}/done/batch={number}")
    keyed.removed(spark, f"{target}/state/edition={number - 2}")  # a repeated chunk reads the edition before its own


def replay(spark: SparkSession, files: DataFrame, target: str, chunk: Column | None = None, most: int | None = None) -> int:
    """Apply pending files in the order of ``chunk`` (the UTC day unless given); the number of chunks applied, at most ``most``."""
    todo, number = pending(spark, files, target)
    todo = todo.withColumn("_chunk", F.date_format(F.timestamp_seconds("epoch_s"), "yyyy-MM-dd") if chunk is None else chunk)
    names = [r[0] for r in todo.select("_chunk").distinct().orderBy("_chunk").collect()][:most]
    for i, name in enumerate(names):
        apply(spark, todo.where(F.col("_chunk") == name).drop("_chunk"), target, number + i)
    return len(names)


def state_of(spark: SparkSession, target: str) -> DataFrame:
    """Latest state after the last finished chunk."""
    last = spark.read.schema("system_id string, epoch_s long, batch int").parquet(f"{target}/done").agg(F.max("batch")).first()[0]
    return spark.read.schema(STATE).parquet(f"{target}/state/edition={last}")


def recompact(rows: DataFrame, path: str, first: str, last: str, every_h: int = 1) -> None:
    """Write the hourly archive of a range of UTC days anew from rows; partitions of other days stay as they are."""
    archive.write_hourly(rows.where(F.to_date("observed_at").between(first, last)), path, every_h=every_h)
