"""The sample table: one lazy plan from observations to labelled, weighted feature rows.

Everything a row holds was known at its time t: states by arrival, profiles and capacity
estimates of the edition of the day before, weather of issues available by then. Only
labels look ahead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.config import Config
from moorline.operators import asof, calendars, exclude, features, labels, reference, sampling, timegrid

KEYS = features.KEYS
FLOW = ["rentals", "returns", "n_changes", "since_change_min"]
STRATUM, FEATURE_SET = "uniform", "v1"


@dataclass(frozen=True)
class Inputs:
    obs: DataFrame
    stations: DataFrame  #: keys, lat, lon, capacity (declared), pref_code, muni_code, region_id, is_charging
    capacities: DataFrame  #: keys, day, capacity_max: the daily maxima that estimates come from
    config: Config
    # beyond the state of the grid:
    edges: DataFrame | None = None
    daily: DataFrame | None = None  #: daily profiles: keys, day, dow_type, slot15 and sums; an edition is the sum of its last ``profile_days``
    profile: DataFrame | None = None  #: the one edition that all rows ask for, as a plain sum; without it each row's own is summed from ``daily``
    days: DataFrame | None = None  #: calendar: date, holiday_name, day_type, dow_type, is_day_before_holiday, is_last_business_day
    issues: DataFrame | None = None  #: issued_hour, available_at
    cells: DataFrame | None = None  #: issued_hour, lat_idx, lon_idx and arrays by lead: precip_mm, temp_c, wind_kmh


def sample_columns(c: Config) -> list[str]:
    """The ordered columns of a sample; serving rows lack the labels and the sampling columns."""
    return [
        *KEYS, "t", "h_min",
        "y_bike", "y_dock",
        "weight", "stratum", "feature_set",
        "minute_of_day", "sin_t", "cos_t", "dow", "day_type", "dow_type", "is_holiday", "is_day_before_holiday", "is_last_business_day", "month", "sin_target", "cos_target", "target_dow_type",
        "lat", "lon", "pref_code", "muni_code", "region_id", "is_charging", "station_age_days", "capacity", "urban_density",
        "bikes", "docks", "gap", "fill_ratio", "is_over_capacity", "staleness_s", "feed_delay_s",
        *[f"lag_{m}" for m in c.lags_min], *[f"delta_{m}" for m in c.deltas_min], "roll_mean", "roll_min", "roll_max",
        "rentals", "returns", "n_changes", "since_change_min",
        "bikes_yesterday", "y_bike_yesterday", "y_dock_yesterday",
        "nb_count_near", "nb_count", "nb_bikes", "nb_docks", "nb_empty", "nb_fill", "nb_count_near_same", "nb_bikes_same", "nb_docks_same",
        "precip_now", "precip_target", "temp_c", "wind_kmh",
        "prof_p_bike", "prof_p_dock", "prof_mean", "prof_std", "prof_rentals", "prof_returns", "prof_n_days",
    ]


LABEL_COLUMNS = ("y_bike", "y_dock", "weight", "stratum", "feature_set")


def observed_state(points: DataFrame, x: Inputs) -> DataFrame:
    """As-of state of every entity at every grid point, with flow and validity: all that profiles need."""
    c = x.config
    flow = features.flow(x.obs, c.flow_min, c.change_cap_min, keep=["bikes", "docks", "flags", "reported_age_s"])
    s = asof.as_of_feature(points, flow, ["bikes", "docks", "flags", "reported_age_s", *FLOW])
    return s.withColumns({"valid": asof.valid("seen", "t", c.staleness_s), "bikes": asof.gather(s, "seen", "bikes"), "docks": asof.gather(s, "seen", "docks")})


def grid_state(points: DataFrame, x: Inputs) -> DataFrame:
    """The observed state with capacity. Other features derive from it."""
    c = x.config
    s = observed_state(points, x)
    known = x.stations.select(*KEYS, F.col("capacity").alias("_declared")).join(reference.capacity_editions(x.capacities), KEYS, "full")
    s = s.join(known, KEYS, "left")
    estimate = F.try_element_at("estimates", F.date_sub(timegrid.local_date(F.col("t"), c.local_offset_h), 1))
    return s.withColumn("capacity", features.capacity(F.col("system_id"), F.col("_declared"), estimate, c.dynamic_systems)).drop("_declared", "estimates")


def point_features(state: DataFrame, points: DataFrame, x: Inputs, keep: Column) -> DataFrame:
    """Features that do not depend on the horizon, of the base points that ``keep(keys, t)`` selects.

    Windows run over the whole grid; neighbours, weather and attributes are joined for kept
    points only.
    """
    c = x.config
    t = F.col("t")
    f = features.rolling(features.lags(state, c.step_min, c.lags_min, c.deltas_min), c.step_min, c.roll_min)
    f = features.yesterday_lags(f, c.step_min, c.horizons_min)
    f = f.where(keep & exclude.base_reason("seen", "t", c.staleness_s).isNull()).select("*", *[F.col(f"seen.{n}").alias(n) for n in FLOW])
    f = features.join_neighbours(f, features.neighbour_sums(state, x.edges, c.near_m, c.far_m, points.where(keep)))
    minute = timegrid.minute_of_day(t, c.local_offset_h)
    sin, cos = calendars.cyclic(minute)
    f = f.withColumns(
        {
            "fill_ratio": features.fill_ratio(F.col("bikes"), F.col("capacity")),
            "gap": features.gap(F.col("system_id"), F.col("capacity"), F.col("bikes"), F.col("docks"), c.gap_systems),
            "is_over_capacity": F.col("bikes") > F.col("capacity"),
            "staleness_s": F.when(F.col("system_id").isin(*c.age_systems), F.col("seen.reported_age_s")),
            "feed_delay_s": F.floor((timegrid.micros(t) - timegrid.micros(F.col("seen.observed_at"))) / 1_000_000),
            "minute_of_day": minute,
            "sin_t": sin,
            "cos_t": cos,
        }
    )
    return with_weather(with_calendar(with_attributes(f, x), x), points, x)


def with_attributes(f: DataFrame, x: Inputs) -> DataFrame:
    """Static columns: position, codes (negative is unknown), charging, age since first seen, and how many entities stand around."""
    code = lambda n: F.when(F.col(n) >= 0, F.col(n)).alias(n)
    known = x.stations.select(*KEYS, "lat", "lon", code("pref_code"), code("muni_code"), code("region_id"), "is_charging")
    density = x.edges.where(F.col("distance_m") <= x.config.far_m).groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("urban_density"))
    first = x.obs.groupBy(*KEYS).agg(F.min("observed_at").alias("_first"))
    facts = first.join(known, KEYS, "left").join(density, KEYS, "left").na.fill(0, ["urban_density"])
    age = (timegrid.micros(F.col("t")) - timegrid.micros(F.col("_first"))) / 86_400_000_000
    return f.join(facts, KEYS, "left").withColumn("station_age_days", age).drop("_first")


def with_calendar(f: DataFrame, x: Inputs) -> DataFrame:
    """The base day's attributes; days are numbered from Monday."""
    days = x.days.select(F.col("date").alias("_date"), F.weekday("date").alias("dow"), "day_type", "dow_type", F.col("holiday_name").isNotNull().alias("is_holiday"), "is_day_before_holiday", "is_last_business_day", F.month("date").alias("month"))
    return f.withColumn("_date", timegrid.local_date(F.col("t"), x.config.local_offset_h)).join(F.broadcast(days), "_date", "left").drop("_date")


def with_weather(f: DataFrame, points: DataFrame, x: Inputs) -> DataFrame:
    """Weather of the newest issue available at t in the entity's cell: arrays stay until horizons are known."""
    c = x.config
    f = f.withColumns({"lat_idx": F.rint(F.col("lat") / c.weather_lat).cast("int"), "lon_idx": F.rint(F.col("lon") / c.weather_lon).cast("int")})
    f = features.newest_cells(f, x.issues, x.cells.withColumnsRenamed({"temp_c": "_temp", "wind_kmh": "_wind"}), points).drop("lat_idx", "lon_idx")
    lead = lambda hour: features.lead_of(F.col("issued_hour"), hour, c.weather_leads)
    t = F.col("t")
    near = lead(features.nearest_hour(t))
    return f.withColumns({"precip_now": F.get("precip_mm", lead(features.containing_hour(t))), "temp_c": F.get("_temp", near), "wind_kmh": F.get("_wind", near)}).drop("_temp", "_wind")


def with_targets(f: DataFrame, x: Inputs) -> DataFrame:
    """One row for each horizon, with target-time calendar, rain, yesterday's outcome and the profile of the day before's edition."""
    c = x.config
    f = f.withColumn("_h", F.explode("history")).select("*", "_h.*").drop("_h", "history").withColumn("target", F.col("t") + timegrid.minutes(F.col("h_min")))
    sin, cos = calendars.cyclic(F.col("minute_of_day") + F.col("h_min"))
    rain = F.get("precip_mm", features.lead_of(F.col("issued_hour"), features.containing_hour(F.col("target")), c.weather_leads))
    f = f.withColumns({"sin_target": sin, "cos_target": cos, "precip_target": rain}).drop("precip_mm", "issued_hour")
    return with_target_profile(f, x)


def with_target_profile(f: DataFrame, x: Inputs) -> DataFrame:
    """target_dow_type and the profile columns of rows with keys, t, minute_of_day, h_min and target."""
    c = x.config
    f = f.withColumn("_date", timegrid.local_date(F.col("target"), c.local_offset_h))
    f = f.join(F.broadcast(x.days.select(F.col("date").alias("_date"), F.col("dow_type").alias("target_dow_type"))), "_date", "left").drop("_date")
    f = f.withColumn("_slot", features.target_slot(F.col("minute_of_day"), F.col("h_min"), c.slot_min))
    if x.profile is not None:
        return features.with_edition(f, x.profile, "_slot", "target_dow_type").drop("_slot")
    edition = F.date_sub(timegrid.local_date(F.col("t"), c.local_offset_h), 1)
    return features.with_profile(f, x.daily, c.profile_days, edition, "_slot", "target_dow_type").drop("_slot")


def drawn_state(points: DataFrame, x: Inputs, sampled: bool = True) -> DataFrame:
    """The grid's state with ``_draws``, a flag for each horizon: which (point, horizon) pairs are drawn. To be written: samples read it several times."""
    c, t = x.config, F.col("t")
    state, n = grid_state(points, x), len(c.horizons_min)
    if not sampled:
        return state.withColumn("_draws", F.array_repeat(F.lit(True), n))
    index = F.floor(timegrid.minute_of_day(t, c.local_offset_h) / c.step_min)
    return sampling.with_draws(state, timegrid.local_date(t, c.local_offset_h), [F.col(k) for k in KEYS], index, n, c.sample_rate)


#: What targets, labels and exclusions read of a point beside a sample's own columns.
INNER = (*KEYS, "t", "minute_of_day", "issued_hour", "precip_mm", "history", "_draws")


def build_samples(state: DataFrame, x: Inputs, sampled: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Labelled samples of the table that ``drawn_state`` made: base and target exclusions, drawn pairs, weights, labels; columns of ``sample_columns``, or those named.

    Rows travel whole through the windows of profiles and labels, where nothing is pruned by itself: what no one
    reads is left behind before each.
    """
    c = x.config
    wanted = columns or sample_columns(c)
    kept = lambda f, *more: f.select(*[n for n in f.columns if n in wanted or n in more])
    f = point_features(state, state.select(*KEYS, "t", "_draws"), x, F.exists("_draws", lambda drawn: drawn))
    f = kept(f.withColumn("_base", F.struct("seen.observed_at", "seen.fetched_at")), *INNER, "_base")
    f = kept(with_targets(f.withColumn("history", F.filter("history", lambda _, i: F.get("_draws", i))).drop("_draws"), x), *KEYS, "target", "_base")
    f = asof.with_truth(f, x.obs, ["bikes", "docks", "flags"], t="target").where(exclude.target_reason("truth", "target", c.staleness_s, "_base").isNull())
    f = f.withColumns({"y_bike": labels.y_bike(F.col("truth.bikes"), F.col("truth.flags")), "y_dock": labels.y_dock(F.col("truth.docks"), F.col("truth.flags")), "stratum": F.lit(STRATUM), "feature_set": F.lit(FEATURE_SET)})
    f = sampling.with_weight(f, c.sample_rate if sampled else 1.0)
    return f.select(*wanted)


def build_now(x: Inputs, at: str, back_min: int, written: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """Serving features of one grid time: the same functions over the little grid that its windows need; no labels, no sampling.

    Only what had arrived by then is read: of daily profiles the days of the edition, of capacities those that the
    grid's editions look back on. ``written(df, name)`` may write the little grid, which is read several times.
    """
    c, now = x.config, F.to_timestamp_ntz(F.lit(timegrid.on_grid(at, x.config.step_min)))
    first = now - timegrid.minutes(back_min)
    before = lambda t: F.date_sub(timegrid.local_date(t, c.local_offset_h), 1)
    edition = before(now)
    profile = reference.sum_dailies(x.daily.where(F.col("day").between(F.date_sub(edition, c.profile_days - 1), edition)))
    capacities = x.capacities.where(F.col("day").between(F.date_sub(before(first), reference.CAPACITY_DAYS - 1), edition))
    x = replace(x, obs=x.obs.where(F.col("fetched_at") <= now), profile=profile, capacities=capacities)
    points = x.obs.select(*KEYS).distinct().withColumn("t", F.explode(F.sequence(first, now, timegrid.minutes(c.step_min))))
    state = written(grid_state(points, x), "little")
    f = point_features(state, state.select(*KEYS, "t").where(F.col("t") == now), x, F.col("t") == now)
    return with_targets(f, x).select(*[n for n in sample_columns(c) if n not in LABEL_COLUMNS])
