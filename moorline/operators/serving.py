"""Read queries: current view, boxes, cells, interpolation, trips, details, rollups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorline.functions import has_bit, haversine

KEYS = ["system_id", "station_id"]


def known(c: Column) -> Column:
    return F.when(c != -1, c)


def current_stations(latest: DataFrame, systems: DataFrame, attributes: DataFrame, estimates: DataFrame, forecasts: DataFrame) -> DataFrame:
    """The current view: latest state of active systems with current attributes, estimated capacity and forecasts.

    -1 is null, flags are three booleans (null where negative), systems of dynamic capacity
    hide the declared one, suspect places are gone; stations without a forecast have nulls there.
    ``systems(system_id, is_active, capacity_is_dynamic)``; ``forecasts`` holds one row a station.
    """
    active = F.broadcast(systems.where("is_active").select("system_id", "capacity_is_dynamic"))
    x = latest.join(active, "system_id").join(attributes, KEYS, "left").join(estimates, KEYS, "left")
    f = F.col("flags")
    carried = ["horizons_min", "p_bike_x1000", "p_dock_x1000", "confidence", "base_observed_at", "model_version", "generated_at"]
    x = x.join(forecasts.select(*KEYS, *[F.col(c).alias(f"forecast_{c}") for c in carried]), KEYS, "left").where(~F.coalesce("geo_suspect", F.lit(False)))
    return x.select(
        *KEYS,
        "name",
        "lat",
        "lon",
        F.when(~F.col("capacity_is_dynamic"), F.col("capacity")).alias("capacity"),
        known(F.col("bikes")).alias("bikes"),
        known(F.col("docks")).alias("docks"),
        *[F.when(f >= 0, has_bit(f, b)).alias(n) for b, n in ((1, "is_installed"), (2, "is_renting"), (4, "is_returning"))],
        "is_present",
        "last_changed_at",
        *[f"forecast_{c}" for c in carried],
        "capacity_est",
        "capacity_days",
    )


def in_box(view: DataFrame, w: float, s: float, e: float, n: float, system: str | None = None) -> DataFrame:
    out = view.where(F.col("lat").between(s, n) & F.col("lon").between(w, e))
    return out if system is None else out.where(F.col("system_id") == system)


def query_box(view: DataFrame, w: float, s: float, e: float, n: float, most: int = 1000) -> DataFrame:
    """Rows of a box; a box of more than ``most`` rows is refused (an error), counted in the same plan."""
    rows = in_box(view, w, s, e, n)
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    rows = rows.join(F.broadcast(total))
    return rows.withColumn("_ok", F.when(F.col("_total") > most, F.raise_error(F.lit("too many stations in the box")).cast("boolean")).otherwise(True)).where("_ok").drop("_ok", "_total")


def snap_box(w: float, s: float, e: float, n: float, step: float = 0.01) -> tuple[float, float, float, float]:
    """The box widened to the grid; scaled values are rounded to nine decimals first."""
    low = lambda x: round(math.floor(round(x / step, 9)) * step, 9)
    high = lambda x: round(math.ceil(round(x / step, 9)) * step, 9)
    return low(w), low(s), high(e), high(n)


def plan_of(w: float, s: float, e: float, n: float) -> str:
    """What answers a box: single stations, fine cells, coarse cells, or a refusal."""
    side = round(max(e - w, n - s), 9)
    return "stations" if side <= 0.08 else "cells_0.01" if side <= 0.25 else "cells_0.05" if side <= 0.5 else "refuse"


def plan_columns(w: Column, s: Column, e: Column, n: Column, step: float = 0.01) -> dict[str, Column]:
    """The same for a table of boxes."""
    side = F.round(F.greatest(e - w, n - s), 9)
    low = lambda x: F.round(F.floor(F.round(x / step, 9)) * step, 9)
    high = lambda x: F.round(F.ceil(F.round(x / step, 9)) * step, 9)
    kind = F.when(side <= 0.08, "stations").when(side <= 0.25, "cells_0.01").when(side <= 0.5, "cells_0.05").otherwise("refuse")
    return {"w": low(w), "s": low(s), "e": high(e), "n": high(n), "plan": kind}


def cells(view: DataFrame, deg: float, forecasts: DataFrame | None = None, horizons: list[int] | None = None, fresh: Column | None = None) -> DataFrame:
    """Grid cells: stations, sums of present ones, staleness, and the element-wise greatest fresh forecast with exactly these horizons."""
    cell = lambda c: F.floor(F.round(F.col(c) / deg, 9)).cast("int")
    x = view.withColumn("cy", cell("lat")).withColumn("cx", cell("lon"))
    here = F.col("is_present")
    out = x.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(here, F.col("bikes"))), F.lit(0)).alias("bikes"), F.coalesce(F.sum(F.when(here, F.col("docks"))), F.lit(0)).alias("docks"), F.bool_or(~here).alias("is_stale"))
    if forecasts is None:
        return out
    f = x.select(*KEYS, "cy", "cx").join(forecasts.where(fresh & (F.col("horizons_min") == F.array(*[F.lit(h) for h in horizons]))), KEYS)
    by_h = f.select("cy", "cx", F.posexplode("p_bike_x1000").alias("i", "p")).groupBy("cy", "cx", "i").agg(F.max("p").alias("p"))
    curve = by_h.groupBy("cy", "cx").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda z: z["p"]).alias("p_bike_x1000"))
    tops = f.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("n_forecast"), F.max("confidence").alias("confidence"), F.min("generated_at").alias("generated_at"))
    return out.join(curve, ["cy", "cx"], "left").join(tops, ["cy", "cx"], "left").na.fill(0, ["n_forecast"])


def interpolate(horizons: Column, p1000: Column, at: Column) -> Column:
    """A forecast at a horizon: clamped at the ends, linear inside, in thousandths; null when the arrays differ in length."""
    z = F.arrays_zip(horizons.alias("h"), p1000.alias("p"))
    below = F.filter(z, lambda x: x["h"] <= at)
    above = F.filter(z, lambda x: x["h"] >= at)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    line = a["p"] + (b["p"] - a["p"]) * (at - a["h"]) / (b["h"] - a["h"])
    value = F.when(F.size(below) == 0, b["p"]).when(F.size(above) == 0, a["p"]).when(a["h"] == b["h"], a["p"]).otherwise(line)
    return F.when((F.size(horizons) == F.size(p1000)) & (F.size(horizons) > 0), F.floor(value + 0.5) / 1000)


def forecast_horizon(in_min: Column, age_min: Column) -> Column:
    return in_min + F.greatest(age_min, F.lit(0))


def is_fresh(age_s: Column, limit_s: int = 900) -> Column:
    return age_s <= limit_s


def stale_after(cadence_s: Column, poll_s: Column) -> Column:
    return 3 * F.greatest(cadence_s, poll_s) + poll_s


def is_stale(age_s: Column, cadence_s: Column, poll_s: Column) -> Column:
    """Older than three cadences and one poll, or never seen."""
    return F.coalesce(age_s > stale_after(cadence_s, poll_s), F.lit(True))


def ride_minutes(distance_m: Column, kmh: float = 14.0) -> Column:
    return F.round(distance_m / (kmh * 1000 / 60)).cast("int")


def trips(pairs: DataFrame, forecasts: DataFrame, attributes: DataFrame, most_min: int = 180) -> DataFrame:
    """Batch of trips ``pairs(from_id, to_id, system_id, depart_min)``: ride, arrival, joint probability and confidence; arrivals too late are refused."""
    side = lambda p, cols: forecasts.join(attributes, KEYS).select("system_id", F.col("station_id").alias(f"{p}_id"), *[F.col(c).alias(f"_{p}_{c}") for c in cols])
    x = pairs.join(side("from", ["lat", "lon", "horizons_min", "p_bike_x1000", "confidence"]), ["system_id", "from_id"]).join(side("to", ["lat", "lon", "horizons_min", "p_dock_x1000", "confidence"]), ["system_id", "to_id"])
    ride = ride_minutes(haversine(F.col("_from_lat"), F.col("_from_lon"), F.col("_to_lat"), F.col("_to_lon")))
    x = x.withColumn("ride_min", ride).withColumn("arrive_min", F.col("depart_min") + F.col("ride_min"))
    pa = interpolate(F.col("_from_horizons_min"), F.col("_from_p_bike_x1000"), F.col("depart_min"))
    pb = interpolate(F.col("_to_horizons_min"), F.col("_to_p_dock_x1000"), F.col("arrive_min"))
    ok = F.col("arrive_min") <= most_min
    return x.select("system_id", "from_id", "to_id", "depart_min", "ride_min", "arrive_min", F.when(ok, F.round(pa * pb, 3)).alias("p_trip"), F.when(ok, F.least("_from_confidence", "_to_confidence")).alias("confidence"), (~ok).alias("refused"))


def alternatives(edges: DataFrame, forecasts: DataFrame, p: str, near_m: int = 400, k: int = 5) -> DataFrame:
    """The k best same-system neighbours with a forecast, by probability, distance and id."""
    nb = forecasts.select(F.col("system_id").alias("nb_system_id"), F.col("station_id").alias("nb_station_id"), F.col(p).alias("p"))
    x = edges.where(F.col("same_system") & (F.col("distance_m") <= near_m)).join(nb, ["nb_system_id", "nb_station_id"])
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("p").desc(), "distance_m", "nb_station_id"))
    return x.withColumn("rank", rank).where(F.col("rank") <= k).select(*KEYS, "rank", "nb_station_id", "p", "distance_m")


def hourly_rollup(obs: DataFrame, before: Column | None = None) -> DataFrame:
    """Means of rows where both counts are known, by entity and completed hour."""
    x = obs.where((F.col("bikes") >= 0) & (F.col("docks") >= 0))
    hour = F.window("observed_at", "1 hour")
    out = x.groupBy(*KEYS, hour.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("bikes").alias("bikes_mean"), F.avg("docks").alias("docks_mean"))
    out = out.select(*KEYS, F.col("w.start").alias("hour_start"), "n", "bikes_mean", "docks_mean")
    return out if before is None else out.where(F.col("hour_start") + F.expr("INTERVAL 1 HOUR") <= before)


def week_trend(trend: DataFrame, days: DataFrame, today: str, most_age: int = 7) -> DataFrame:
    """The next seven days' 24 usual values of each station: the slice of its 72 that the day's kind picks; old editions give null."""
    d = days.where(F.col("date").between(F.to_date(F.lit(today)), F.date_add(F.to_date(F.lit(today)), 6))).select("date", F.when(F.col("dow_type") == "sat", 0).when(F.col("dow_type") == "sun_holiday", 1).otherwise(2).alias("k"))
    x = trend.join(F.broadcast(d))
    fresh = F.datediff(F.to_date(F.lit(today)), "profile_date") <= most_age
    return x.select(*KEYS, "date", F.when(fresh, F.slice("p_x1000", F.col("k") * 24 + 1, F.lit(24))).alias("hours"))


def is_unbounded(*counts: Column, limit: int = 1000) -> Column:
    return F.coalesce(F.greatest(*counts) >= limit, F.lit(False))
