"""As-of joins by one union and one running window: no range join, one shuffle on the entity key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("system_id", "station_id")


def _merged(points: DataFrame, obs: DataFrame, t: str, order: str, keys: tuple[str, ...], payload: list[str]) -> DataFrame:
    seen = obs.select(*keys, F.col(order).alias("_time"), F.lit(0).alias("_point"), F.struct(*payload).alias("_seen"), F.lit(None).cast(points.schema[t].dataType).alias("_t"))
    ask = points.select(*keys, F.col(t).alias("_time"), F.lit(1).alias("_point"), F.lit(None).cast(seen.schema["_seen"].dataType).alias("_seen"), F.col(t).alias("_t"))
    return seen.unionByName(ask)


def as_of_feature(points: DataFrame, obs: DataFrame, payload: list[str], out: str = "seen", t: str = "t", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """What was known at each point: among rows with fetched_at <= t, the one of greatest (observed_at, fetched_at).

    ``points(keys, t)`` gains the struct ``out`` of observed_at, fetched_at and payload, or
    null. A row fetched exactly at t counts.
    """
    fields = ["observed_at", "fetched_at", *payload]
    rows = _merged(points, obs, t, "fetched_at", keys, fields)
    running = Window.partitionBy(*keys).orderBy("_time", "_point").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.max("_seen").over(running)).where("_point = 1").select(*keys, F.col("_t").alias(t), out)


def as_of_label(points: DataFrame, obs: DataFrame, payload: list[str], out: str = "truth", t: str = "t", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """What was true at each point: the row of greatest (observed_at, fetched_at) with observed_at <= t, whenever it arrived."""
    fields = ["observed_at", "fetched_at", *payload]
    rows = _merged(points, obs, t, "observed_at", keys, fields)
    running = Window.partitionBy(*keys).orderBy("_time", "_point").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.max("_seen").over(running)).where("_point = 1").select(*keys, F.col("_t").alias(t), out)


def with_truth(rows: DataFrame, obs: DataFrame, payload: list[str], out: str = "truth", t: str = "t", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The label as-of for rows that keep all their columns: they travel through the running window themselves, so nothing is joined back."""
    seen = obs.select(*keys, F.col("observed_at").alias("_time"), F.lit(0).alias("_point"), F.struct("observed_at", "fetched_at", *payload).alias("_seen"))
    seen = seen.withColumn("_row", F.lit(None).cast(rows.schema))
    ask = rows.select(*keys, F.col(t).alias("_time"), F.lit(1).alias("_point"), F.lit(None).cast(seen.schema["_seen"].dataType).alias("_seen"), F.struct(*rows.columns).alias("_row"))
    running = Window.partitionBy(*keys).orderBy("_time", "_point").rowsBetween(Window.unboundedPreceding, 0)
    return seen.unionByName(ask).withColumn(out, F.max("_seen").over(running)).where("_point = 1").select("_row.*", out)


def base_observation(obs: DataFrame, step_min: int, start: str, end: str, key: str = "system_id") -> DataFrame:
    """(key, t, base_observed_at) for each grid time from start to end: the newest observation that had arrived by t.

    Arrivals fold to the grid time from which they count, so the running maximum sees one row
    for each key and grid time, not the observations.
    """
    us = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    step, first = step_min * 60_000_000, F.unix_micros(F.lit(start).cast("timestamp_ntz").cast("timestamp"))
    slot = F.greatest(F.ceil((us - first) / step), F.lit(0)).cast("long").alias("_slot")
    newest = obs.groupBy(key, slot).agg(F.max("observed_at").alias("_o"))
    last = F.floor((F.unix_micros(F.lit(end).cast("timestamp_ntz").cast("timestamp")) - first) / step).cast("long")
    grid = obs.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_slot"))
    running = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(newest, [key, "_slot"], "left").withColumn("base_observed_at", F.max("_o").over(running))
    return out.select(key, F.timestamp_micros(first + F.col("_slot") * step).cast("timestamp_ntz").alias("t"), "base_observed_at")


def gather(df: DataFrame, struct: str, field: str, missing: int = -1):  # noqa: ANN201
    """A field of an as-of result, or the sentinel where nothing was found."""
    return F.coalesce(F.col(f"{struct}.{field}"), F.lit(missing))


def unreferenced(obs: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Observed entities that the ledger does not know, with their row counts."""
    return obs.join(ledger.select(*keys).distinct(), list(keys), "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def aligned(obs: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Ledger entities with their observations: unknown ones dropped, unseen ones kept with nulls; a doubled key counts once."""
    return ledger.select(*keys).distinct().join(obs, list(keys), "left")


def valid(struct: str, t: str, staleness_s: int):  # noqa: ANN201
    """A row exists, its count was observed, and it is not stale."""
    seen = F.col(struct)
    age = F.unix_micros(F.col(t).cast("timestamp")) - F.unix_micros(seen["observed_at"].cast("timestamp"))
    return F.coalesce(seen.isNotNull() & (seen["bikes"] != -1) & (age <= staleness_s * 1_000_000), F.lit(False))
