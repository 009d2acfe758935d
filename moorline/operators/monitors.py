"""Data-quality monitors: each returns the alerts, or the facts they rest on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorline.operators.timegrid import micros


def age_s(now: Column, at: Column) -> Column:
    return F.floor((micros(now) - micros(at)) / 1_000_000)


def daily_quality(systems: DataFrame, snapshots: DataFrame, errors: DataFrame, offset_h: int = 9) -> DataFrame:
    """Snapshots against the expected number, greatest gap inside the local day, anomalies and errors, by system and day.

    ``systems(system_id, cadence_s)``; a system with no snapshots on a day still appears.
    """
    local = F.to_date(F.col("observed_at") + F.make_dt_interval(hours=F.lit(offset_h)))
    s = snapshots.withColumn("day", local)
    s = s.withColumn("_next", F.lead("observed_at").over(Window.partitionBy("system_id", "day").orderBy("observed_at")))
    per = s.groupBy("system_id", "day").agg(F.count(F.lit(1)).alias("n_snapshots"), F.max(age_s(F.col("_next"), F.col("observed_at"))).alias("max_gap_s"), F.count_if("is_anomalous").alias("n_anomalies"))
    days = s.select("day").distinct()
    err = errors.groupBy("system_id", F.to_date(F.col("started_at") + F.make_dt_interval(hours=F.lit(offset_h))).alias("day")).agg(F.count(F.lit(1)).alias("n_errors"))
    every = systems.crossJoin(days)
    out = every.join(per, ["system_id", "day"], "left").join(err, ["system_id", "day"], "left").na.fill(0, ["n_snapshots", "n_anomalies", "n_errors"])
    return out.select("system_id", "day", F.expr("86400 div cadence_s").alias("n_expected"), "n_snapshots", "max_gap_s", "n_anomalies", "n_errors")


def stalled(state: DataFrame, now: Column, errors: int = 5, silent_s: int = 600) -> DataFrame:
    """Feeds that are stalled, failing in a row, or silent: state(system_id, cadence_s, poll_s, last_observed_at, last_attempt_at, consecutive_errors)."""
    limit = 3 * F.greatest("cadence_s", "poll_s") + F.col("poll_s")
    checks = {"stalled": F.coalesce(age_s(now, F.col("last_observed_at")) > limit, F.lit(True)), "errors": F.col("consecutive_errors") >= errors, "silent": F.coalesce(age_s(now, F.col("last_attempt_at")) > silent_s, F.lit(True))}
    return state.select("system_id", *[c.alias(k) for k, c in checks.items()]).unpivot(["system_id"], list(checks), "alert", "fires").where("fires").drop("fires")


def count_shift(snapshots: DataFrame, now: Column, share: float = 0.05) -> DataFrame:
    """Systems whose newest snapshot lists many more or fewer stations than the median of 23 to 25 hours before."""
    newest = snapshots.groupBy("system_id").agg(F.max_by("n", "observed_at").alias("n_now"))
    old = snapshots.where(F.col("observed_at").between(now - F.expr("INTERVAL 25 HOURS"), now - F.expr("INTERVAL 23 HOURS"))).groupBy("system_id").agg(F.median("n").alias("n_before"))
    x = newest.join(old, "system_id")
    return x.withColumn("shift", F.round(F.abs(F.col("n_now") - F.col("n_before")) / F.col("n_before"), 9)).where(F.col("shift") > share)


def jobs_missing(registry: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Registered jobs without an ok run inside their window; fresh registrations have their window as grace."""
    last = runs.where("status = 'ok'").groupBy("job").agg(F.max("started_at").alias("last_ok_at"))
    x = registry.join(last, "job", "left")
    return x.where((age_s(now, F.col("registered_at")) > F.col("window_s")) & F.coalesce(age_s(now, F.col("last_ok_at")) > F.col("window_s"), F.lit(True))).select("job", "last_ok_at")


def jobs_failed(runs: DataFrame, now: Column, hours: int = 3) -> DataFrame:
    """Failures of the last hours: count, last time, and the last error by time."""
    x = runs.where((F.col("status") == "failed") & (F.col("started_at") > now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("started_at") <= now))
    return x.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.max("started_at").alias("last_at"), F.max_by("error", F.struct("started_at", "run_id")).alias("last_error"))


def jobs_stuck(runs: DataFrame, now: Column, limit_s: int = 3600) -> DataFrame:
    x = runs.where((F.col("status") == "running") & (age_s(now, F.col("started_at")) > limit_s))
    return x.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.min("started_at").alias("oldest"), F.max("started_at").alias("newest"))


def inference_health(runs: DataFrame, logged: DataFrame, now: Column, stale_s: int = 900) -> DataFrame:
    """By system: age of the last ok cycle, cycles still running too long, and ok cycles without a log row."""
    ok = runs.where("status = 'ok'")
    a = ok.groupBy("system_id").agg(F.max("started_at").alias("last_ok_at"))
    b = runs.where("status = 'running'").groupBy("system_id").agg(F.count_if(age_s(now, F.col("started_at")) > stale_s).alias("n_stuck"))
    c = ok.join(logged.select("run_id").distinct(), "run_id", "left_anti").groupBy("system_id").agg(F.count(F.lit(1)).alias("n_unlogged"))
    x = a.join(b, "system_id", "left").join(c, "system_id", "left").na.fill(0, ["n_stuck", "n_unlogged"])
    return x.withColumn("is_stale", age_s(now, F.col("last_ok_at")) > stale_s)


def freshness(df: DataFrame, at: str, now: Column, limit_s: int, name: str) -> DataFrame:
    """One row: the newest time of a table, and whether it is too old."""
    return df.agg(F.max(at).alias("newest")).select(F.lit(name).alias("what"), "newest", F.coalesce(age_s(now, F.col("newest")) > limit_s, F.lit(True)).alias("fires"))


def model_age(models: DataFrame, today: str, limit_days: int = 8) -> DataFrame:
    """Days since each model's last training day (the greatest of its array)."""
    last = F.array_max("train_days")
    age = F.datediff(F.to_date(F.lit(today)), last)
    return models.select("model", last.alias("last_day"), age.alias("age_days"), (age >= limit_days).alias("fires"))


def shadow_failing(cycles: DataFrame, k: int = 3) -> DataFrame:
    """Systems whose last k ok cycles were all judged and none healthy, with those cycles' verdicts in time order."""
    w = Window.partitionBy("system_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    top = cycles.where("status = 'ok'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    x = top.groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), F.count("healthy").alias("n_judged"), F.count_if("healthy").alias("n_healthy"), F.transform(F.array_sort(F.collect_list(F.struct("started_at", "run_id"))), lambda z: z["run_id"]).alias("runs"))
    return x.withColumn("fires", (F.col("n") == k) & (F.col("n_judged") == k) & (F.col("n_healthy") == 0))


def job_sets(registered: DataFrame, actual: DataFrame) -> DataFrame:
    """Jobs in one set only, or inactive."""
    x = registered.select("job", F.lit(True).alias("_r")).join(actual.select("job", "is_active"), "job", "full_outer")
    kind = F.when(F.col("is_active").isNull(), "missing").when(F.col("_r").isNull(), "unmonitored").when(~F.col("is_active"), "inactive")
    return x.select("job", kind.alias("kind")).where(F.col("kind").isNotNull())


def suppress(events: DataFrame, key: str, at: str, interval_s: int) -> DataFrame:
    """Which alerts are sent: one for each key and interval since the last *sent*.

    Rows stream through their task in order of key and time; only the last sent time is
    held, and from a sent alert the next one is found by binary search.
    """
    us = interval_s * 1_000_000
    rows = events.select(F.col(key).alias("key"), micros(F.col(at)).alias("us")).where("us is not null").repartition("key").sortWithinPartitions("key", "us")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sent = None, None
        for part in parts:
            keys, null, out = part["key"].to_numpy(), part["key"].isna().to_numpy(), []
            other = (null[1:] != null[:-1]) | (~null[1:] & ~null[:-1] & (keys[1:] != keys[:-1]))
            starts = np.flatnonzero(np.concatenate([[True], other])) if len(keys) else []
            times = part["us"].to_numpy()
            for i, start in enumerate(starts):
                stop = starts[i + 1] if i + 1 < len(starts) else len(keys)
                name = None if null[start] else (keys[start],)  # null is a key of its own
                if i or name != held or sent is None:
                    held, sent = name, None
                j = start if sent is None else start + int(np.searchsorted(times[start:stop], sent + us))
                while j < stop:
                    sent = int(times[j])
                    out.append(j)
                    j = start + int(np.searchsorted(times[start:stop], sent + us))
            yield part.iloc[out]

    sent = rows.mapInPandas(run, f"key {events.schema[key].dataType.simpleString()}, us long")
    return sent.select(F.col("key").alias(key), F.timestamp_micros("us").cast("timestamp_ntz").alias("sent_at"))
