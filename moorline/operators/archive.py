"""Archive layouts, pruning, gaps, reconciliation, fingerprints, retention and replay selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.operators import keyed


def write_hourly(long: DataFrame, path: str, before: Column | None = None, every_h: int = 1) -> None:
    """Long rows to system_id/date/hour directories (UTC), zstd, sorted by entity and time; a rerun overwrites just its partitions.

    ``before``: only hours that ended by then are written. ``every_h``: hours in a directory, for sparse feeds.
    """
    rows = long.withColumn("date", F.date_format("observed_at", "yyyy-MM-dd")).withColumn("hour", F.lpad((F.floor(F.hour("observed_at") / every_h) * every_h).cast("string"), 2, "0"))
    if before is not None:
        rows = rows.where(F.date_trunc("hour", F.col("observed_at")) + F.expr("INTERVAL 1 HOUR") <= before)
    keyed.swing(rows, path, ["system_id", "date", "hour"], ["station_id", "observed_at"])


def read_hours(spark: SparkSession, path: str, schema, hours: list[tuple[str, str]]) -> DataFrame:  # noqa: ANN001
    """Rows of the given (date, hour) partitions only."""
    df = spark.read.schema(schema).parquet(path)
    by_date: dict[str, list[str]] = {}
    for d, h in hours:
        by_date.setdefault(d, []).append(h)
    keep = F.lit(False)
    for d, hs in by_date.items():
        keep = keep | ((F.col("date") == d) & F.col("hour").isin(hs))
    return df.where(keep)


def assert_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, when its own columns are exactly ``names``; Spark would fill missing ones with nulls."""
    if sorted(df.columns) != sorted(names):
        raise ValueError(f"columns {sorted(set(df.columns) ^ set(names))} differ from the contract")
    return df


def local_day_hours(days: DataFrame, day: str, offset_h: int, back_h: int, ahead_h: int) -> DataFrame:
    """UTC hours that cover a local day with margins, and one more in front for rows that arrived late."""
    start = F.col(day).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(offset_h + back_h + 1))
    end = F.col(day).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(24 - offset_h + ahead_h - 1))
    return days.select(day, F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))).alias("hour"))


def gaps(observed: DataFrame, archived: DataFrame, keys: list[str], now: Column | None = None, hours: int = 6) -> DataFrame:
    """Hours that hold snapshots but no archive file; with ``now``, of the last ``hours`` hours without the newest, which may still be open."""
    if now is not None:
        newest = F.date_trunc("hour", now).cast("timestamp_ntz")
        observed = observed.where((F.col("hour") >= newest - F.make_dt_interval(hours=F.lit(hours))) & (F.col("hour") < newest))
    return observed.select(*keys).distinct().join(archived.select(*keys).distinct(), keys, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows that differ: only on one side, or some value unequal (null equals null, NaN equals NaN)."""
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*keys, "kind")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of rows on one side only over the shared columns, repeated rows included: two equal builds give zeros."""
    shared = [c for c in left.columns if c in right.columns]
    rows = left.select(*shared, F.lit(1).alias("_s")).unionByName(right.select(*shared, F.lit(-1).alias("_s")))
    net = rows.groupBy(*shared).agg(F.sum("_s").alias("_n"))
    return net.agg(F.coalesce(F.sum(F.greatest("_n", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("_n"), F.lit(0))), F.lit(0)).alias("only_right"))


def fingerprint(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows and an order-free digest of each partition: sums of two 32-bit halves of each row's md5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    h = F.md5(text.cast("binary"))
    part = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("long")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part(1)).alias("digest_a"), F.sum(part(9)).alias("digest_b"))


def expired(df: DataFrame, at: str, now: Column, days: int) -> Column:
    """Rows older than the keep-window."""
    return F.col(at) < now - F.make_dt_interval(days=F.lit(days))


#: Days that each kind of row is kept. Of job runs, those of these jobs that ended well outlive the others.
KEEP_DAYS = {"job_runs": 30, "inference_ok": 90, "fetch_log": 30, "weather": 30, "profiles": 35}
KEEP_HOURS, KEEP_MONTHS_DAYS = 26, 60


def kept_run(job: str, status: str, at: str, now: Column, inference: tuple[str, ...]) -> Column:
    """Whether a job run stays: good runs of inference jobs longer than the rest."""
    days = F.when(F.col(job).isin(*inference) & (F.col(status) == "ok"), KEEP_DAYS["inference_ok"]).otherwise(KEEP_DAYS["job_runs"])
    return F.col(at) >= now - F.make_dt_interval(days=days)


def kept_hour(at: str, now: Column) -> Column:
    """Whether a row of the hourly rollup stays."""
    return F.col(at) >= now - F.make_dt_interval(hours=F.lit(KEEP_HOURS))


def kept_month(at: str, now: Column) -> Column:
    """Whether a snapshot's month stays: a month goes as a whole, once all of it is older than the window."""
    end = F.add_months(F.trunc(F.to_date(at), "month"), 1)
    return end.cast("timestamp_ntz") > now - F.make_dt_interval(days=F.lit(KEEP_MONTHS_DAYS))


def pending_replay(objects: DataFrame, ingested: DataFrame, first: str, last: str) -> DataFrame:
    """Raw objects of a day range whose epoch (from the file name) is not ingested yet, in time order."""
    epoch = F.regexp_extract("path", r"(\d{10})\.json(\.gz)?$", 1)
    found = objects.where(epoch != "").withColumn("epoch_s", epoch.cast("long"))
    found = found.where(F.to_date(F.timestamp_seconds("epoch_s")).between(first, last))
    return found.join(ingested.select("system_id", "epoch_s").distinct(), ["system_id", "epoch_s"], "left_anti").orderBy("epoch_s", "path")


def write_profile(profile: DataFrame, path: str) -> None:
    """Profiles clustered by cell: a reader of some (dow_type, slot15) opens those directories only."""
    profile.repartition("dow_type", "slot15").sortWithinPartitions("system_id", "station_id").write.mode("overwrite").partitionBy("dow_type", "slot15").parquet(path)


def write_forecast_log(forecasts: DataFrame, path: str, every_h: int = 1) -> None:
    """One row for each station and cycle, arrays by horizon, under system, UTC date and hour of the base time, cycle and model version.

    A cycle that runs again replaces its own directory, whatever else the hour holds. ``every_h``: hours in a directory.
    """
    at = F.col("base_observed_at")
    rows = forecasts.withColumns({"date": F.date_format(at, "yyyy-MM-dd"), "hour": F.lpad((F.floor(F.hour(at) / every_h) * every_h).cast("string"), 2, "0"), "cycle": F.unix_timestamp(at.cast("timestamp")), "version": F.col("model_version")})
    keyed.swing(rows, path, ["system_id", "date", "hour", "cycle", "version"], ["station_id"])
