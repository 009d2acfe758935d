"""Queries of calendars, features, reference data and profiles."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.config import SPARSE
from moorline.operators import asof, build, calendars, features, reference, timegrid
from moorline.plans import q_grid as G
from moorline.plans.scratch import dealt, written
from moorline.sources import tables as T

KEYS = features.KEYS


def holidays(spark: SparkSession, d: str) -> DataFrame:
    """A holiday list from order dates."""
    o = T.read(spark, d, "orders").where("o_orderkey % 97 = 0")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.min("o_orderpriority").alias("name"))


def event_days(spark: SparkSession, d: str) -> DataFrame:
    """Calendar of the events' days; their holidays are days with few errors."""
    e = T.read(spark, d, "events")
    rare = e.where("event_id % 991 = 0").groupBy(timegrid.local_date(F.col("ts"), 9).alias("date")).agg(F.min("event_type").alias("name"))
    return calendars.calendar(spark, "2023-12-31", "2024-02-02", rare)


EVENT_DAYS = """edays AS (SELECT date, CASE WHEN monthday >= 1229 OR monthday <= 103 OR hol THEN 'sun_holiday' WHEN dow = 0 THEN 'sun_holiday' WHEN dow = 6 THEN 'sat' ELSE 'weekday' END AS dow_type FROM (
  SELECT date, month(date) * 100 + day(date) AS monthday, dayofweek(date) AS dow, date IN (SELECT (ts + INTERVAL 9 HOUR)::DATE FROM events WHERE event_id % 991 = 0) AS hol
  FROM (SELECT unnest(generate_series(DATE '2023-12-31', DATE '2024-02-02', INTERVAL 1 DAY))::DATE AS date)))"""


def state(spark: SparkSession, d: str) -> DataFrame:
    """State of the grid."""
    return build.grid_state(G.grid_points(spark, d), state_inputs(spark, d))


def observed(spark: SparkSession, d: str, days: tuple[str, str] | None = None) -> DataFrame:
    """State of the grid without capacities, of the local days from one to another if named."""
    points = G.grid_points(spark, d)
    if days:
        points = points.where(timegrid.local_date(F.col("t"), 9).between(*days))
    return build.observed_state(points, state_inputs(spark, d))


def sample_state(spark: SparkSession, d: str, sampled: bool = True) -> DataFrame:
    """The whole grid's state with its drawn pairs, written once for all that a sample reads of it."""
    return written(build.drawn_state(G.grid_points(spark, d), state_inputs(spark, d), sampled), "state")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of stations within 500 m: the stations are dealt before each meets those of nine cells."""
    return reference.neighbours(dealt(T.stations(spark, d), *KEYS), 500.0)


def usable_points(spark: SparkSession, d: str, s: DataFrame | None = None) -> DataFrame:
    """Grid points for profiles, of a state that is at hand or of the whole grid: a fresh observed row exists; suspended ones stay."""
    s = (observed(spark, d) if s is None else s).where("valid").select(*KEYS, "t", "seen.*")
    days = event_days(spark, d).select(F.col("date").alias("day"), "dow_type")
    s = s.withColumn("day", timegrid.local_date(F.col("t"), 9)).withColumn("slot15", F.floor(timegrid.minute_of_day(F.col("t"), 9) / SPARSE.slot_min).cast("int"))
    return s.join(F.broadcast(days), "day")


def dailies(spark: SparkSession, d: str, s: DataFrame | None = None) -> DataFrame:
    return reference.daily_profile(usable_points(spark, d, s), ["day", "dow_type", "slot15"])


def profile(spark: SparkSession, d: str, last: str = "2024-12-31") -> DataFrame:
    return reference.sum_dailies(dailies(spark, d).where(F.col("day") <= last))


def state_inputs(spark: SparkSession, d: str) -> build.Inputs:
    """What the state of the grid needs: observations, attributes and capacities."""
    k = F.col("station_id").cast("long")
    stations = T.stations(spark, d).select("*", (k % 40 - 1).cast("int").alias("muni_code"), F.when(F.col("system_id") == "a", k % 9).cast("int").alias("region_id"))
    o = T.obs_long(spark, d)
    maxima = reference.daily_capacity_max(o, timegrid.local_date(F.col("observed_at"), 9))
    return build.Inputs(obs=o, stations=stations, capacities=maxima, config=SPARSE)


def inputs(spark: SparkSession, d: str, s: DataFrame | None = None, times: DataFrame | None = None) -> build.Inputs:
    issues, cells = weather(spark, d, times)
    return dataclasses.replace(state_inputs(spark, d), edges=edges(spark, d), daily=dailies(spark, d, s), days=event_days(spark, d), issues=issues, cells=cells)


def grid_times(spark: SparkSession) -> DataFrame:
    return timegrid.grid(spark, G.START, G.END, SPARSE.step_min)


def build_inputs(spark: SparkSession, d: str, s: DataFrame, times: DataFrame) -> build.Inputs:
    """Inputs of a build at ``times(t)``: pairs of stations are written once, since sums and densities both read them."""
    x = inputs(spark, d, s, times)
    return dataclasses.replace(x, edges=written(x.edges, "edges"))


def fea_01_calendar(spark: SparkSession, d: str) -> DataFrame:
    return calendars.calendar(spark, "1995-01-01", "2001-08-01", holidays(spark, d))


def fea_02_dow_ids(spark: SparkSession, d: str) -> DataFrame:
    c = event_days(spark, d)
    e = T.read(spark, d, "events").select(timegrid.local_date(F.col("ts"), 9).alias("date"))
    return e.join(F.broadcast(c), "date").groupBy("dow_type", calendars.dow_id(F.col("dow_type")).alias("dow_id")).agg(F.count(F.lit(1)).alias("n"))


def fea_03_business_days(spark: SparkSession, d: str) -> DataFrame:
    c = fea_01_calendar(spark, d)
    return c.groupBy(F.year("date").alias("year"), "day_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_day_before_holiday").alias("n_before"), F.count_if("is_last_business_day").alias("n_last"))


def fea_04_cyclic(spark: SparkSession, d: str) -> DataFrame:
    o = T.obs_long(spark, d)
    m = timegrid.minute_of_day(F.col("observed_at"), 9)
    days = event_days(spark, d)
    o = o.withColumn("minute", m).withColumn("date", timegrid.local_date(F.col("observed_at"), 9)).withColumn("next", F.date_add("date", 1))
    o = o.join(F.broadcast(days.select("date", F.col("dow_type").alias("dow"))), "date").join(F.broadcast(days.select(F.col("date").alias("next"), F.col("dow_type").alias("dow_next"))), "next")
    o = o.withColumn("h_min", F.explode(F.array(*[F.lit(h) for h in SPARSE.horizons_min])))
    sin, cos = calendars.cyclic(F.col("minute") + F.col("h_min"))
    return o.select(*KEYS, "observed_at", "h_min", (F.round(sin, 6) + 0.0).alias("sin_target"), (F.round(cos, 6) + 0.0).alias("cos_target"), calendars.target_dow(F.col("dow"), F.col("dow_next"), F.col("minute"), F.col("h_min")).alias("target_dow"))


def fea_05_static(spark: SparkSession, d: str) -> DataFrame:
    o = T.obs_long(spark, d)
    seen = o.groupBy(*KEYS).agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("t"))
    s = T.stations(spark, d).select(*KEYS, "lat", "lon", F.when(F.col("pref_code") >= 0, F.col("pref_code")).alias("pref_code"), "is_charging")
    age = (timegrid.micros(F.col("t")) - timegrid.micros(F.col("first_seen_at"))) / 86_400_000_000
    return seen.join(s, KEYS, "left").select(*KEYS, "lat", "lon", "pref_code", "is_charging", F.round(age, 6).alias("station_age_days"))


def fea_06_capacity(spark: SparkSession, d: str) -> DataFrame:
    s = T.stations(spark, d)
    return s.select(*KEYS, features.capacity(F.col("system_id"), F.col("capacity"), F.col("capacity_est"), SPARSE.dynamic_systems).alias("capacity"))


def fea_07_state(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d).where("valid")
    f = F.col
    return s.select(
        *KEYS,
        "t",
        F.round(features.fill_ratio(f("bikes"), f("capacity")), 9).alias("fill_ratio"),
        features.gap(f("system_id"), f("capacity"), f("bikes"), f("docks"), SPARSE.gap_systems).alias("gap"),
        (f("bikes") > f("capacity")).alias("is_over_capacity"),
        F.when(f("system_id") == "b", f("seen.reported_age_s")).alias("staleness_s"),
        F.floor((timegrid.micros(f("t")) - timegrid.micros(f("seen.observed_at"))) / 1_000_000).alias("feed_delay_s"),
    )


def fea_08_lags(spark: SparkSession, d: str) -> DataFrame:
    s = features.lags(state(spark, d), SPARSE.step_min, SPARSE.lags_min, SPARSE.deltas_min)
    return s.select(*KEYS, "t", "lag_360", "lag_720", "lag_1440", "delta_720", "delta_1440")


def fea_09_rolling(spark: SparkSession, d: str) -> DataFrame:
    s = features.rolling(state(spark, d), SPARSE.step_min, SPARSE.roll_min)
    return s.select(*KEYS, "t", F.round("roll_mean", 9).alias("roll_mean"), "roll_min", "roll_max")


def fea_10_flow(spark: SparkSession, d: str) -> DataFrame:
    return features.flow(T.obs_long(spark, d), SPARSE.flow_min, SPARSE.change_cap_min).select(*KEYS, "observed_at", "rentals", "returns", "n_changes")


def fea_11_since_change(spark: SparkSession, d: str) -> DataFrame:
    return features.flow(T.obs_long(spark, d), SPARSE.flow_min, SPARSE.change_cap_min).select(*KEYS, "observed_at", F.round("since_change_min", 6).alias("since_change_min"))


def fea_12_yesterday(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    return features.yesterday(s, s.select(*KEYS, "t"), {"bikes_yesterday": F.col("bikes"), "y_bike_yesterday": (F.col("bikes") >= 1).cast("int")})


def fea_13_neighbours(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    x = features.join_neighbours(s.select(*KEYS, "t"), features.neighbour_sums(s, edges(spark, d), SPARSE.near_m, SPARSE.far_m))
    return x.select(*KEYS, "t", "nb_bikes", "nb_docks", "nb_empty", "nb_count", F.round("nb_fill", 9).alias("nb_fill"), "nb_bikes_same", "nb_count_same")


def weather(spark: SparkSession, d: str, times: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues, cells with arrays by lead) from the hours of view events. With ``times(t)`` cells grow only the issues that some of these times asks for, which are those that ``newest_cells`` keeps."""
    e = T.read(spark, d, "events").where("event_type = 'view'")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    issues = e.select(hour.alias("issued_hour"), (hour + F.make_dt_interval(mins=35 + F.col("event_id") % 50)).alias("available_at"))
    cells = dealt(reference.weather_cells(T.stations(spark, d), SPARSE.weather_lat, SPARSE.weather_lon).select("lat_idx", "lon_idx"), "lat_idx", "lon_idx")
    hours = F.sequence(F.to_timestamp_ntz(F.lit("2023-12-31 00:00:00")), F.to_timestamp_ntz(F.lit("2024-02-02 00:00:00")), F.expr("INTERVAL 1 HOUR"))
    held = spark.range(1).select(F.explode(hours).alias("issued_hour")).join(issues.select("issued_hour").distinct(), "issued_hour", "left_semi")
    if times is not None:
        held = held.join(features.issue_times(times, issues).select("issued_hour").distinct(), "issued_hour", "left_semi")
    rows = cells.crossJoin(F.broadcast(held))  # a calendar's hours
    start = (timegrid.micros(F.col("issued_hour")) / 3_600_000_000).cast("long")
    by_lead = lambda value: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: value(k).cast("double"))
    rows = rows.withColumn("precip_mm", by_lead(lambda k: (start + k * 3 + F.col("lat_idx")) % 37))
    return issues, rows.withColumn("temp_c", by_lead(lambda k: (start + k * 5 + F.col("lon_idx")) % 41 - 5)).withColumn("wind_kmh", by_lead(lambda k: (start + k * 7) % 29))


def fea_14_weather(spark: SparkSession, d: str) -> DataFrame:
    times = grid_times(spark)
    issues, cells = weather(spark, d, times)
    index = lambda at, step: F.rint(F.col(at) / step).cast("int")
    p = G.grid_points(spark, d, T.stations(spark, d).select(*KEYS, index("lat", SPARSE.weather_lat).alias("lat_idx"), index("lon", SPARSE.weather_lon).alias("lon_idx")))
    p = features.newest_cells(p, issues, cells, times)
    at = lambda t: F.get("precip_mm", features.lead_of(F.col("issued_hour"), t, SPARSE.weather_leads))
    t = F.col("t")
    return p.select(*KEYS, "t", "issued_hour", at(features.containing_hour(t)).alias("precip_t"), at(features.containing_hour(t + timegrid.minutes(180))).alias("precip_target"), at(features.nearest_hour(t + timegrid.minutes(90))).alias("nearest_90"))


def fea_15_profile_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = G.grid_points(spark, d).withColumn("minute_of_day", timegrid.minute_of_day(F.col("t"), 9))
    p = p.withColumn("h_min", F.explode(F.array(*[F.lit(h) for h in SPARSE.horizons_min]))).withColumn("target", F.col("t") + timegrid.minutes(F.col("h_min")))
    x = build.with_target_profile(p, inputs(spark, d))
    return x.select(*KEYS, "t", "h_min", "prof_n_days", *[F.round(c, 9).alias(c) for c in ("prof_p_bike", "prof_p_dock", "prof_mean", "prof_std", "prof_rentals", "prof_returns")])


def rounded(df: DataFrame) -> DataFrame:
    """Floating columns at nine digits (angles at six), without negative zeros."""
    return df.select(*[(F.round(n, 6 if n[:4] in ("sin_", "cos_") else 9) + F.lit(0.0)).alias(n) if kind == "double" else F.col(n) for n, kind in df.dtypes])


def samples(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    """Samples with all their columns, or with those named."""
    s = sample_state(spark, d)
    return rounded(build.build_samples(s, build_inputs(spark, d, s, grid_times(spark)), columns=columns))


def fea_16_samples(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d)


SERVED = "2024-01-22 00:00:00"


def fea_17_point_build(spark: SparkSession, d: str) -> DataFrame:
    edition = observed(spark, d, ("2023-12-25", "2024-01-22"))  # its days and the day of t, of which build_now takes the edition's
    x = build_inputs(spark, d, edition, grid_times(spark).where(f"t = '{SERVED}'"))
    return rounded(build.build_now(x, SERVED, 1440, written))


def fea_18_coverage(spark: SparkSession, d: str) -> DataFrame:
    w = fea_14_weather(spark, d).withColumn("day", F.to_date("t"))
    return features.coverage(w, ["day"], ["precip_t", "precip_target", "nearest_90"])


def fea_18_spread(spark: SparkSession, d: str) -> DataFrame:
    return features.spread_pp(fea_18_coverage(spark, d), "n_all", "n").select(F.round("spread_pp", 6).alias("spread_pp"))


def fea_19_encode(spark: SparkSession, d: str) -> DataFrame:
    s = T.stations(spark, d).select(*KEYS, "is_charging", "capacity").withColumn("kind", F.when(F.col("capacity").isNotNull(), F.element_at(F.array(F.lit("sat"), F.lit("sun_holiday"), F.lit("weekday")), F.col("capacity") % 3 + 1)))
    return features.encode(s.withColumn("system", F.col("system_id")), {"kind": ("sat", "sun_holiday", "weekday"), "system": ("a", "b")}, ["is_charging"])


def fea_20_base(spark: SparkSession, d: str) -> DataFrame:
    """For each cycle: the newest observation of its system ingested by then, at most a day old."""
    x = asof.base_observation(T.obs_long(spark, d), 360, G.START, G.END)
    return x.where(F.col("base_observed_at") >= F.col("t") - F.expr("INTERVAL 1 DAY"))


def ref_01_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


def ref_02_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    pages = T.read(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://", "").alias("address"))
    names = T.read(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/]{1,4})", 1).alias("prefix")).union(T.read(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/]{2})", 1).alias("prefix")))
    names = names.where("prefix <> ''").distinct().withColumn("code", F.length("prefix"))
    return reference.longest_prefix(pages, "address", names, "prefix", ["page_id"]).select("page_id", "prefix", "code")


def ref_03_daily_capacity(spark: SparkSession, d: str) -> DataFrame:
    return reference.daily_capacity_max(T.obs_long(spark, d), timegrid.local_date(F.col("observed_at"), 9))


def ref_04_capacity_estimate(spark: SparkSession, d: str) -> DataFrame:
    return reference.capacity_estimate(ref_03_daily_capacity(spark, d))


def ref_05_edition(spark: SparkSession, d: str) -> DataFrame:
    o = T.obs_long(spark, d)
    ledger = o.groupBy(*KEYS).agg(F.min("observed_at").alias("first_seen_at"))
    est = ref_04_capacity_estimate(spark, d).where(F.col("day") == "2024-01-20").select(*KEYS, "capacity_est", "days_used")
    return reference.stations_edition(ledger, T.stations(spark, d).where("not geo_suspect").select(*KEYS, "lat", "lon", "capacity"), est)


def ref_06_weather_cells(spark: SparkSession, d: str) -> DataFrame:
    return reference.weather_cells(T.stations(spark, d), SPARSE.weather_lat, SPARSE.weather_lon)


def ref_07_activity(spark: SparkSession, d: str) -> DataFrame:
    from moorline.plans.q_ingest import _packed

    ledger, arrays = _packed(spark, d)
    return reference.activity(arrays, ledger, F.to_timestamp_ntz(F.lit("2024-01-20 06:00:00")), 72, 36).select(*KEYS, "last_seen_at", "is_active")


def pro_01_daily(spark: SparkSession, d: str) -> DataFrame:
    return dailies(spark, d)


def pro_02_roll(spark: SparkSession, d: str) -> DataFrame:
    """P(D) = P(D-1) + d(D) - d(D-28), which must equal the plain sum of 28 days. The daily table is written once and read three times."""
    x = written(dailies(spark, d), "dailies")
    previous = reference.sum_dailies(x.where(F.col("day").between("2024-01-01", "2024-01-28")))
    return reference.roll(previous, x.where(F.col("day") == "2024-01-29").drop("day"), x.where(F.col("day") == "2024-01-01").drop("day"))


def pro_03_serving_cells(spark: SparkSession, d: str) -> DataFrame:
    days = event_days(spark, d)
    at = G.grid_points(spark, d).select("t").distinct().withColumn("minute", timegrid.minute_of_day(F.col("t"), 9)).withColumn("date", timegrid.local_date(F.col("t"), 9)).withColumn("next", F.date_add("date", 1))
    at = at.join(days.select("date", F.col("dow_type").alias("dow")), "date").join(days.select(F.col("date").alias("next"), F.col("dow_type").alias("dow_next")), "next")
    return reference.serving_cells(at, SPARSE.horizons_min, SPARSE.slot_min)


def pro_03_edition(spark: SparkSession, d: str) -> DataFrame:
    days = T.obs_long(spark, d).select(timegrid.local_date(F.col("observed_at"), 9).alias("day")).distinct()
    return reference.edition(days.where(F.dayofmonth("day") % 3 == 0), days, "day", 2)


def pro_04_summary(spark: SparkSession, d: str) -> DataFrame:
    return reference.summarize(profile(spark, d), {"weekday": 3, "sat": 2, "sun_holiday": 2})


_NAMES = [n for n in list(globals()) if n[:4] in ("fea_", "ref_", "pro_")]
QUERIES = {n: globals()[n] for n in _NAMES}

CAL = """hol AS (SELECT o_orderdate::DATE AS date, min(o_orderpriority) AS name FROM orders WHERE o_orderkey % 97 = 0 GROUP BY 1),
span AS (SELECT unnest(generate_series(DATE '1994-11-20', DATE '2001-09-15', INTERVAL 1 DAY))::DATE AS date),
fixed AS (SELECT s.date, hol.name, CASE WHEN month(s.date) * 100 + day(s.date) >= 1229 OR month(s.date) * 100 + day(s.date) <= 103 THEN 'newyear' WHEN month(s.date) * 100 + day(s.date) BETWEEN 813 AND 816 THEN 'obon'
  WHEN hol.name IS NOT NULL THEN 'holiday' WHEN dayofweek(s.date) = 0 THEN 'sun' WHEN dayofweek(s.date) = 6 THEN 'sat' END AS f FROM span s LEFT JOIN hol ON hol.date = s.date),
around AS (SELECT *, lag(f IS NOT NULL) OVER (ORDER BY date) AS b, lead(f IS NOT NULL) OVER (ORDER BY date) AS a, max(CASE WHEN f IS NULL THEN date END) OVER (PARTITION BY date_trunc('month', date)) AS lb FROM fixed),
cal AS (SELECT date, name AS holiday_name, coalesce(f, CASE WHEN a AND b THEN 'bridge' ELSE 'weekday' END) AS day_type, f IS NOT NULL AS is_off, coalesce(a, false) AS is_day_before_holiday, date = lb AS is_last_business_day FROM around WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-08-01')"""
DM = "dm AS (SELECT system_id, station_id, (observed_at + INTERVAL 9 HOUR)::DATE AS day, max(bikes + docks)::INT AS capacity_max FROM obs WHERE bikes <> -1 AND docks <> -1 GROUP BY ALL)"
STATE = f"""{T.OBS}, {T.STATIONS}, {G.GRID}, {DM}, f0 AS (
  SELECT p.system_id, p.station_id, p.t, max(struct_pack(observed_at := o.observed_at, fetched_at := o.fetched_at, bikes := o.bikes, docks := o.docks, flags := o.flags, age := o.reported_age_s)) FILTER (o.observed_at IS NOT NULL) AS seen
  FROM points p LEFT JOIN obs o ON o.system_id = p.system_id AND o.station_id = p.station_id AND o.fetched_at <= p.t GROUP BY ALL),
capx AS (SELECT system_id, station_id, edition, max(capacity_max) AS est FROM (SELECT *, day + unnest([0, 1, 2, 3, 4, 5, 6])::INT AS edition FROM dm) GROUP BY ALL),
state AS MATERIALIZED (SELECT f0.system_id, f0.station_id, t, seen, coalesce(seen.bikes, -1) AS bikes, coalesce(seen.docks, -1) AS docks,
  CASE WHEN f0.system_id = 'b' THEN CASE WHEN est > 0 THEN est END ELSE CASE WHEN s.capacity > 0 THEN s.capacity END END AS capacity,
  coalesce(seen IS NOT NULL AND seen.bikes <> -1 AND epoch_us(t) - epoch_us(seen.observed_at) <= 86400000000, false) AS valid FROM f0 LEFT JOIN stations s ON s.system_id = f0.system_id AND s.station_id = f0.station_id
  LEFT JOIN capx ON capx.system_id = f0.system_id AND capx.station_id = f0.station_id AND capx.edition = (t + INTERVAL 9 HOUR)::DATE - 1)"""
FLOW = """sf AS (SELECT *, bikes - lag(bikes) OVER (PARTITION BY system_id, station_id ORDER BY observed_at, fetched_at) AS dl, row_number() OVER (PARTITION BY system_id, station_id ORDER BY observed_at, fetched_at) AS rn FROM obs WHERE bikes <> -1),
flow AS (SELECT system_id, station_id, observed_at, fetched_at, sum(greatest(-dl, 0)) OVER b::INT AS rentals, sum(greatest(dl, 0)) OVER b::INT AS returns, coalesce(sum((dl <> 0)::INT) OVER b, 0)::INT AS n_changes,
  CASE WHEN rn >= 2 THEN least(coalesce((epoch_us(observed_at) - max(CASE WHEN dl <> 0 THEN epoch_us(observed_at) END) OVER r) / 60000000.0, 4320.0), 4320.0) END AS since
  FROM sf WINDOW b AS (PARTITION BY system_id, station_id ORDER BY observed_at RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW), r AS (PARTITION BY system_id, station_id ORDER BY observed_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0)))"
EDGES = f"""edges AS (SELECT system_id, station_id, nb_system_id, nb_station_id, round(dist)::INT AS distance_m, system_id = nb_system_id AS same_system FROM (
  SELECT a.system_id, a.station_id, b.system_id AS nb_system_id, b.station_id AS nb_station_id, {HAV} AS dist FROM stations a JOIN stations b ON abs(a.lat - b.lat) < 0.0101 AND NOT (a.system_id = b.system_id AND a.station_id = b.station_id)
  WHERE NOT a.geo_suspect AND NOT b.geo_suspect AND abs(a.lon - b.lon) < 0.0101) WHERE dist <= 500)"""
NB = """nb AS (SELECT e.system_id, e.station_id, s.t, sum(CASE WHEN distance_m <= 300 THEN greatest(s.bikes, 0) ELSE 0 END)::BIGINT AS nb_bikes, sum(CASE WHEN distance_m <= 300 THEN greatest(s.docks, 0) ELSE 0 END)::BIGINT AS nb_docks,
  count(*) FILTER (s.bikes = 0) AS nb_empty, count(*) AS nb_count, count(*) FILTER (distance_m <= 300) AS nb_count_near, count(*) FILTER (distance_m <= 300 AND same_system) AS nb_count_near_same, avg(CASE WHEN s.bikes >= 0 THEN s.bikes / s.capacity::DOUBLE END) AS nb_fill,
  sum(CASE WHEN distance_m <= 300 AND same_system THEN greatest(s.bikes, 0) ELSE 0 END)::BIGINT AS nb_bikes_same, sum(CASE WHEN distance_m <= 300 AND same_system THEN greatest(s.docks, 0) ELSE 0 END)::BIGINT AS nb_docks_same, count(*) FILTER (same_system) AS nb_count_same
  FROM edges e JOIN state s ON s.system_id = e.nb_system_id AND s.station_id = e.nb_station_id GROUP BY ALL)"""
PROFILE = f"""{EVENT_DAYS}, usable AS (SELECT s.system_id, s.station_id, s.t, seen.bikes AS bikes, seen.docks AS docks, seen.flags AS flags, fl.rentals, fl.returns, (s.t + INTERVAL 9 HOUR)::DATE AS day,
    ((hour(s.t + INTERVAL 9 HOUR) * 60 + minute(s.t + INTERVAL 9 HOUR)) // 360)::INT AS slot15 FROM state s LEFT JOIN flow fl ON fl.system_id = s.system_id AND fl.station_id = s.station_id AND fl.observed_at = s.seen.observed_at AND fl.fetched_at = s.seen.fetched_at WHERE valid),
daily AS MATERIALIZED (SELECT system_id, station_id, day, dow_type, slot15, count(*) AS n, count(*) FILTER (NOT (flags >= 0 AND (flags & 2) > 0 AND (flags & 4) > 0)) AS n_suspended,
  sum((bikes >= 1 AND flags >= 0 AND (flags & 2) > 0)::INT)::BIGINT AS n_bike_ok, sum((docks >= 1 AND flags >= 0 AND (flags & 4) > 0)::INT)::BIGINT AS n_dock_ok, sum(bikes)::BIGINT AS sum_bikes, sum(bikes * bikes)::BIGINT AS sum_bikes_sq,
  sum(coalesce(rentals, 0))::BIGINT AS sum_rentals, sum(coalesce(returns, 0))::BIGINT AS sum_returns FROM usable u JOIN edays e ON e.date = u.day GROUP BY ALL)"""


def _sum(where: str) -> str:
    return f"SELECT system_id, station_id, dow_type, slot15, count(*) AS n_days, {', '.join(f'sum({c})::BIGINT AS {c}' for c in reference.SUMS)} FROM daily WHERE {where} GROUP BY ALL"


PROF = f"""prof AS ({_sum("true")})"""
ECAL = """ehol AS (SELECT (ts + INTERVAL 9 HOUR)::DATE AS date, min(event_type) AS name FROM events WHERE event_id % 991 = 0 GROUP BY 1),
efix AS (SELECT s.date, ehol.name, CASE WHEN month(s.date) * 100 + day(s.date) >= 1229 OR month(s.date) * 100 + day(s.date) <= 103 THEN 'newyear' WHEN month(s.date) * 100 + day(s.date) BETWEEN 813 AND 816 THEN 'obon'
  WHEN ehol.name IS NOT NULL THEN 'holiday' WHEN dayofweek(s.date) = 0 THEN 'sun' WHEN dayofweek(s.date) = 6 THEN 'sat' END AS f FROM (SELECT unnest(generate_series(DATE '2023-11-21', DATE '2024-03-13', INTERVAL 1 DAY))::DATE AS date) s LEFT JOIN ehol ON ehol.date = s.date),
earound AS (SELECT *, lag(f IS NOT NULL) OVER (ORDER BY date) AS b, lead(f IS NOT NULL) OVER (ORDER BY date) AS a, max(CASE WHEN f IS NULL THEN date END) OVER (PARTITION BY date_trunc('month', date)) AS lb FROM efix),
ecal AS (SELECT date, name IS NOT NULL AS is_holiday, coalesce(f, CASE WHEN a AND b THEN 'bridge' ELSE 'weekday' END) AS day_type, coalesce(a, false) AS is_day_before_holiday, coalesce(date = lb, false) AS is_last_business_day FROM earound WHERE date BETWEEN DATE '2023-12-31' AND DATE '2024-02-02')"""
EDITION = f"""pe AS (SELECT a.system_id, a.station_id, a.dow, a.slot, a.edition, count(d.day)::INT AS n_days, {', '.join(f'sum(d.{c})::BIGINT AS {c}' for c in reference.SUMS)}
  FROM (SELECT DISTINCT system_id, station_id, dow, slot, edition FROM asks) a LEFT JOIN daily d ON d.system_id = a.system_id AND d.station_id = a.station_id AND d.dow_type = a.dow AND d.slot15 = a.slot AND d.day BETWEEN a.edition - 27 AND a.edition GROUP BY ALL)"""
RATIOS = """round(n_bike_ok / n::DOUBLE, 9) + 0.0::DOUBLE AS prof_p_bike, round(n_dock_ok / n::DOUBLE, 9) + 0.0::DOUBLE AS prof_p_dock, round(sum_bikes / n::DOUBLE, 9) + 0.0::DOUBLE AS prof_mean,
  CASE WHEN n IS NOT NULL THEN round(sqrt(greatest(sum_bikes_sq / n::DOUBLE - (sum_bikes / n::DOUBLE) * (sum_bikes / n::DOUBLE), 0.0)), 9) END + 0.0::DOUBLE AS prof_std, round(sum_rentals / n::DOUBLE, 9) + 0.0::DOUBLE AS prof_rentals, round(sum_returns / n::DOUBLE, 9) + 0.0::DOUBLE AS prof_returns"""
LAGS = ", ".join(f"CASE WHEN valid THEN lag(CASE WHEN valid THEN bikes END, {m // 360}) OVER w END AS lag_{m}" for m in (360, 720, 1440))
_YB = "(bikes >= 1 AND seen.flags >= 0 AND (seen.flags & 2) > 0)::INT"
_YD = "(docks >= 1 AND seen.flags >= 0 AND (seen.flags & 4) > 0)::INT"
HISTORY = ", ".join(f"lag(CASE WHEN valid THEN {y} END, {(1440 - h) // 360}) OVER w AS {n}_{h}" for h in (360, 720, 1440) for n, y in (("hb", _YB), ("hd", _YD)))
WXQ = """iss AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS issued_hour, max(date_trunc('hour', ts)::TIMESTAMP + to_minutes(35 + event_id % 50)) AS available_at FROM events WHERE event_type = 'view' GROUP BY 1),
ti AS (SELECT t, max(issued_hour) AS i FROM (SELECT DISTINCT t FROM points) p LEFT JOIN iss ON available_at <= t GROUP BY t),
cells AS (SELECT DISTINCT round_even(lat / 0.05, 0)::INT AS la, round_even(lon / 0.0625, 0)::INT AS lo FROM stations WHERE NOT geo_suspect),
wx AS (SELECT p.system_id, p.station_id, p.t, ti.i, round_even(s.lat / 0.05, 0)::INT AS la, c.la IS NOT NULL AS known FROM points p JOIN stations s ON s.system_id = p.system_id AND s.station_id = p.station_id JOIN ti ON ti.t = p.t
  LEFT JOIN cells c ON c.la = round_even(s.lat / 0.05, 0)::INT AND c.lo = round_even(s.lon / 0.0625, 0)::INT),
wv AS (SELECT system_id, station_id, t, i, la, known, (epoch(t) - epoch(i)) / 3600 AS l0, (epoch(t) + 10800 - epoch(i)) / 3600 AS l3, (epoch(t) + 7200 - epoch(i)) / 3600 AS l2 FROM wx)"""


def _lead(lead: str, value: str) -> str:
    return f"CASE WHEN known AND {lead} BETWEEN 0 AND 7 THEN ({value})::DOUBLE END"


def _wx(lead: str) -> str:
    return _lead(lead, f"(epoch(i)::BIGINT // 3600 + {lead}::BIGINT * 3 + la) % 37")


WXS = f"WITH {T.OBS}, {T.STATIONS}, {G.GRID}, {WXQ}, w AS (SELECT system_id, station_id, t, i AS issued_hour, {_wx('l0')} AS precip_t, {_wx('l3')} AS precip_target, {_wx('l2')} AS nearest_90 FROM wv)"
DAYMAX = f"{T.OBS}, {DM}, ce AS (SELECT system_id, station_id, day, max(capacity_max) OVER w AS capacity_est, (count(capacity_max) OVER w)::INT AS days_used FROM dm WINDOW w AS (PARTITION BY system_id, station_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))"
FULL = f"""{STATE}, {FLOW}, {EDGES}, {NB}, {PROFILE}, {ECAL}, {WXQ},
dens AS (SELECT system_id, station_id, count(*)::INT AS urban_density FROM edges GROUP BY ALL), firsts AS (SELECT system_id, station_id, min(observed_at) AS first_at FROM obs GROUP BY ALL),
lagged AS (SELECT *, {LAGS}, {HISTORY}, avg(CASE WHEN valid THEN bikes END) OVER w4 AS roll_mean, min(CASE WHEN valid THEN bikes END) OVER w4 AS roll_min, max(CASE WHEN valid THEN bikes END) OVER w4 AS roll_max, lag(CASE WHEN valid THEN bikes END, 4) OVER w AS bikes_yesterday
  FROM state WINDOW w AS (PARTITION BY system_id, station_id ORDER BY t), w4 AS (PARTITION BY system_id, station_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
base AS (SELECT l.*, fl.rentals, fl.returns, fl.n_changes, fl.since, coalesce(nb_count_near, 0) AS nb_count_near, coalesce(nb_count, 0) AS nb_count, coalesce(nb_bikes, 0) AS nb_bikes, coalesce(nb_docks, 0) AS nb_docks, coalesce(nb_empty, 0) AS nb_empty, nb_fill,
    coalesce(nb_count_near_same, 0) AS nb_count_near_same, coalesce(nb_bikes_same, 0) AS nb_bikes_same, coalesce(nb_docks_same, 0) AS nb_docks_same, (hour(l.t + INTERVAL 9 HOUR) * 60 + minute(l.t + INTERVAL 9 HOUR))::INT AS minute_of_day, (l.t + INTERVAL 9 HOUR)::DATE AS local_day FROM lagged l
  LEFT JOIN flow fl ON fl.system_id = l.system_id AND fl.station_id = l.station_id AND fl.observed_at = l.seen.observed_at AND fl.fetched_at = l.seen.fetched_at
  LEFT JOIN nb ON nb.system_id = l.system_id AND nb.station_id = l.station_id AND nb.t = l.t WHERE ({G.BASE_REASON.replace("seen", "l.seen").replace("epoch_us(t)", "epoch_us(l.t)")}) IS NULL),
asks AS MATERIALIZED (SELECT b.*, h.h_min, b.t + to_minutes(h.h_min) AS target, e.dow_type AS dow, ((b.minute_of_day + h.h_min) % 1440) // 360 AS slot, b.local_day - 1 AS edition, CASE h.h_min WHEN 360 THEN hb_360 WHEN 720 THEN hb_720 ELSE hb_1440 END AS hb, CASE h.h_min WHEN 360 THEN hd_360 WHEN 720 THEN hd_720 ELSE hd_1440 END AS hd
  FROM base b CROSS JOIN (SELECT unnest([360, 720, 1440]) AS h_min) h LEFT JOIN edays e ON e.date = (b.t + to_minutes(h.h_min) + INTERVAL 9 HOUR)::DATE), {EDITION},
tgt AS MATERIALIZED (SELECT k.*, p.n_days, {', '.join(f'p.{c} AS {c}' for c in reference.SUMS)}, ti.i, s.lat, s.lon, s.pref_code, s.is_charging, f.first_at, dens.urban_density, c.la IS NOT NULL AS known, round_even(s.lat / 0.05, 0)::INT AS la, round_even(s.lon / 0.0625, 0)::INT AS lo,
    (epoch(k.t) - epoch(ti.i)) / 3600 AS l0, (epoch(k.target) - epoch(ti.i)) / 3600 AS lt, cd.day_type, cd.is_holiday, cd.is_day_before_holiday, cd.is_last_business_day, bd.dow_type AS base_dow_type
  FROM asks k LEFT JOIN pe p ON p.system_id = k.system_id AND p.station_id = k.station_id AND p.dow = k.dow AND p.slot = k.slot AND p.edition = k.edition LEFT JOIN ti ON ti.t = k.t LEFT JOIN stations s ON s.system_id = k.system_id AND s.station_id = k.station_id
  LEFT JOIN firsts f ON f.system_id = k.system_id AND f.station_id = k.station_id LEFT JOIN dens ON dens.system_id = k.system_id AND dens.station_id = k.station_id LEFT JOIN cells c ON c.la = round_even(s.lat / 0.05, 0)::INT AND c.lo = round_even(s.lon / 0.0625, 0)::INT
  LEFT JOIN ecal cd ON cd.date = k.local_day LEFT JOIN edays bd ON bd.date = k.local_day)"""


def _angle(f: str, minute: str) -> str:
    return f"round({f}(2 * pi() * (({minute}) % 1440) / 1440), 6) + 0.0::DOUBLE"


COLS = f"""system_id, station_id, t, h_min, minute_of_day, {_angle('sin', 'minute_of_day')} AS sin_t, {_angle('cos', 'minute_of_day')} AS cos_t, (isodow(local_day) - 1)::INT AS dow, day_type, base_dow_type AS dow_type, is_holiday, is_day_before_holiday, is_last_business_day, month(local_day)::INT AS month,
  {_angle('sin', 'minute_of_day + h_min')} AS sin_target, {_angle('cos', 'minute_of_day + h_min')} AS cos_target, dow AS target_dow_type, round(lat, 9) + 0.0::DOUBLE AS lat, round(lon, 9) + 0.0::DOUBLE AS lon, pref_code, CASE WHEN lat IS NOT NULL AND station_id::BIGINT % 40 >= 1 THEN (station_id::BIGINT % 40 - 1)::INT END AS muni_code,
  CASE WHEN lat IS NOT NULL AND system_id = 'a' THEN (station_id::BIGINT % 9)::INT END AS region_id, is_charging, round((epoch_us(t) - epoch_us(first_at)) / 86400000000.0::DOUBLE, 9) + 0.0::DOUBLE AS station_age_days, capacity, coalesce(urban_density, 0)::INT AS urban_density,
  bikes, docks, CASE WHEN system_id = 'a' THEN capacity - bikes - docks END AS gap, round(bikes / capacity::DOUBLE, 9) + 0.0::DOUBLE AS fill_ratio, bikes > capacity AS is_over_capacity, CASE WHEN system_id = 'b' THEN seen.age END AS staleness_s, floor((epoch_us(t) - epoch_us(seen.observed_at)) / 1000000)::BIGINT AS feed_delay_s,
  lag_360, lag_720, lag_1440, bikes - lag_720 AS delta_720, bikes - lag_1440 AS delta_1440, round(roll_mean, 9) + 0.0::DOUBLE AS roll_mean, roll_min, roll_max, rentals, returns, n_changes, round(since, 9) + 0.0::DOUBLE AS since_change_min, bikes_yesterday, hb AS y_bike_yesterday, hd AS y_dock_yesterday,
  nb_count_near, nb_count, nb_bikes, nb_docks, nb_empty, round(nb_fill, 9) + 0.0::DOUBLE AS nb_fill, nb_count_near_same, nb_bikes_same, nb_docks_same, {_wx('l0')} + 0.0::DOUBLE AS precip_now, {_wx('lt')} + 0.0::DOUBLE AS precip_target,
  {_lead('l0', '(epoch(i)::BIGINT // 3600 + l0::BIGINT * 5 + lo) % 41 - 5')} + 0.0::DOUBLE AS temp_c, {_lead('l0', '(epoch(i)::BIGINT // 3600 + l0::BIGINT * 7) % 29')} + 0.0::DOUBLE AS wind_kmh, {RATIOS}, coalesce(n_days, 0)::INT AS prof_n_days"""

ORACLE = {
    "fea_01_calendar": f"WITH {CAL} SELECT date, holiday_name, day_type, CASE WHEN day_type = 'sat' THEN 'sat' WHEN day_type IN ('weekday', 'bridge') THEN 'weekday' ELSE 'sun_holiday' END AS dow_type, is_off, is_day_before_holiday, coalesce(is_last_business_day, false) AS is_last_business_day FROM cal",
    "fea_02_dow_ids": f"WITH {EVENT_DAYS} SELECT dow_type, CASE dow_type WHEN 'sat' THEN 0 WHEN 'sun_holiday' THEN 1 ELSE 2 END AS dow_id, count(*) AS n FROM events JOIN edays ON date = (ts + INTERVAL 9 HOUR)::DATE GROUP BY ALL",
    "fea_03_business_days": f"WITH {CAL} SELECT year(date)::INT AS year, day_type, count(*) AS n, count(*) FILTER (is_day_before_holiday) AS n_before, count(*) FILTER (is_last_business_day) AS n_last FROM cal GROUP BY ALL",
    "fea_04_cyclic": f"""WITH {T.OBS}, {EVENT_DAYS}, x AS (SELECT *, (observed_at + INTERVAL 9 HOUR)::DATE AS date, (hour(observed_at + INTERVAL 9 HOUR) * 60 + minute(observed_at + INTERVAL 9 HOUR))::INT AS m, unnest([360, 720, 1440]) AS h_min FROM obs)
SELECT system_id, station_id, observed_at, h_min, round(sin(2 * pi() * ((m + h_min) % 1440) / 1440), 6) + 0.0::DOUBLE AS sin_target, round(cos(2 * pi() * ((m + h_min) % 1440) / 1440), 6) + 0.0::DOUBLE AS cos_target, CASE WHEN m + h_min >= 1440 THEN b.dow_type ELSE a.dow_type END AS target_dow
FROM x JOIN edays a ON a.date = x.date JOIN edays b ON b.date = x.date + 1""",
    "fea_05_static": f"""WITH {T.OBS}, {T.STATIONS}, x AS (SELECT system_id, station_id, min(observed_at) AS f, max(observed_at) AS t FROM obs GROUP BY ALL)
SELECT x.system_id, x.station_id, lat, lon, pref_code, is_charging, round((epoch_us(t) - epoch_us(f)) / 86400000000.0::DOUBLE, 6) AS station_age_days FROM x LEFT JOIN stations s ON s.system_id = x.system_id AND s.station_id = x.station_id""",
    "fea_06_capacity": f"WITH {T.STATIONS} SELECT system_id, station_id, CASE WHEN system_id = 'b' THEN CASE WHEN capacity_est > 0 THEN capacity_est END ELSE CASE WHEN capacity > 0 THEN capacity END END AS capacity FROM stations",
    "fea_07_state": f"""WITH {STATE} SELECT system_id, station_id, t, round(bikes / capacity::DOUBLE, 9) AS fill_ratio, CASE WHEN system_id = 'a' THEN capacity - bikes - docks END AS gap, bikes > capacity AS is_over_capacity,
  CASE WHEN system_id = 'b' THEN seen.age END AS staleness_s, floor((epoch_us(t) - epoch_us(seen.observed_at)) / 1000000)::BIGINT AS feed_delay_s FROM state WHERE valid""",
    "fea_08_lags": f"WITH {STATE}, l AS (SELECT *, {LAGS} FROM state WINDOW w AS (PARTITION BY system_id, station_id ORDER BY t)) SELECT system_id, station_id, t, lag_360, lag_720, lag_1440, bikes - lag_720 AS delta_720, bikes - lag_1440 AS delta_1440 FROM l",
    "fea_09_rolling": f"WITH {STATE} SELECT system_id, station_id, t, round(avg(CASE WHEN valid THEN bikes END) OVER w, 9) AS roll_mean, min(CASE WHEN valid THEN bikes END) OVER w AS roll_min, max(CASE WHEN valid THEN bikes END) OVER w AS roll_max FROM state WINDOW w AS (PARTITION BY system_id, station_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "fea_10_flow": f"WITH {T.OBS}, {FLOW} SELECT system_id, station_id, observed_at, rentals, returns, n_changes FROM flow",
    "fea_11_since_change": f"WITH {T.OBS}, {FLOW} SELECT system_id, station_id, observed_at, round(since, 6) AS since_change_min FROM flow",
    "fea_12_yesterday": f"WITH {STATE} SELECT s.system_id, s.station_id, s.t, CASE WHEN o.valid THEN o.bikes END AS bikes_yesterday, CASE WHEN o.valid THEN (o.bikes >= 1)::INT END AS y_bike_yesterday FROM state s LEFT JOIN state o ON o.system_id = s.system_id AND o.station_id = s.station_id AND o.t = s.t - INTERVAL 1 DAY",
    "fea_13_neighbours": f"""WITH {STATE}, {EDGES}, {NB} SELECT s.system_id, s.station_id, s.t, coalesce(nb_bikes, 0) AS nb_bikes, coalesce(nb_docks, 0) AS nb_docks, coalesce(nb_empty, 0) AS nb_empty, coalesce(nb_count, 0) AS nb_count, round(nb_fill, 9) AS nb_fill, coalesce(nb_bikes_same, 0) AS nb_bikes_same, coalesce(nb_count_same, 0) AS nb_count_same
FROM state s LEFT JOIN nb ON nb.system_id = s.system_id AND nb.station_id = s.station_id AND nb.t = s.t""",
    "fea_14_weather": f"{WXS} SELECT * FROM w",
    "fea_15_profile_lookup": f"""WITH {STATE}, {FLOW}, {PROFILE}, asks AS MATERIALIZED (SELECT p.*, h.h_min, e.dow_type AS dow, ((hour(t + INTERVAL 9 HOUR) * 60 + minute(t + INTERVAL 9 HOUR))::INT + h.h_min) % 1440 // 360 AS slot, (t + INTERVAL 9 HOUR)::DATE - 1 AS edition
  FROM points p CROSS JOIN (SELECT unnest([360, 720, 1440]) AS h_min) h LEFT JOIN edays e ON e.date = (t + to_minutes(h.h_min) + INTERVAL 9 HOUR)::DATE), {EDITION}
SELECT k.system_id, k.station_id, k.t, k.h_min, coalesce(n_days, 0)::INT AS prof_n_days, {RATIOS} FROM asks k LEFT JOIN pe ON pe.system_id = k.system_id AND pe.station_id = k.station_id AND pe.dow = k.dow AND pe.slot = k.slot AND pe.edition = k.edition""",
    "fea_16_samples": f"""WITH {FULL}, {G.DRAWN}, lab AS (SELECT t.*, o.truth FROM tgt t JOIN (SELECT q.system_id, q.station_id, q.target, max(struct_pack(observed_at := o.observed_at, fetched_at := o.fetched_at, bikes := o.bikes, docks := o.docks, flags := o.flags)) FILTER (o.observed_at IS NOT NULL) AS truth
  FROM (SELECT DISTINCT system_id, station_id, target FROM tgt) q LEFT JOIN obs o ON o.system_id = q.system_id AND o.station_id = q.station_id AND o.observed_at <= q.target GROUP BY ALL) o ON o.system_id = t.system_id AND o.station_id = t.station_id AND o.target = t.target)
SELECT {COLS}, (truth.bikes >= 1 AND truth.flags >= 0 AND (truth.flags & 2) > 0)::INT AS y_bike, (truth.docks >= 1 AND truth.flags >= 0 AND (truth.flags & 4) > 0)::INT AS y_dock, 4.0::DOUBLE AS weight, 'uniform' AS stratum, 'v1' AS feature_set FROM lab
WHERE ({G.TARGET_REASON}) IS NULL AND (system_id, station_id, t, h_min) IN (SELECT (system_id, station_id, t, h_min) FROM drawn)""",
    "fea_17_point_build": f"WITH {FULL} SELECT {COLS} FROM tgt WHERE t = TIMESTAMP '2024-01-22'",
    "fea_18_coverage": f"{WXS} SELECT t::DATE AS day, count(*) AS n, count(*) FILTER (precip_t IS NOT NULL AND precip_target IS NOT NULL AND nearest_90 IS NOT NULL) AS n_all, count(precip_t) AS n_precip_t, count(precip_target) AS n_precip_target, count(nearest_90) AS n_nearest_90 FROM w GROUP BY 1",
    "fea_18_spread": f"{WXS}, c AS (SELECT t::DATE AS day, count(*) FILTER (precip_t IS NOT NULL AND precip_target IS NOT NULL AND nearest_90 IS NOT NULL) / count(*)::DOUBLE * 100 AS s FROM w GROUP BY 1) SELECT round(max(s) - min(s), 6) AS spread_pp FROM c",
    "fea_19_encode": f"WITH {T.STATIONS} SELECT system_id, station_id, is_charging::INT::DOUBLE AS is_charging, capacity, CASE WHEN capacity IS NOT NULL THEN (capacity % 3)::DOUBLE END AS kind, CASE WHEN system_id = 'a' THEN 0.0 ELSE 1.0 END::DOUBLE AS system FROM stations",
    "fea_20_base": f"""WITH {T.OBS}, c AS (SELECT * FROM (SELECT DISTINCT system_id FROM obs), (SELECT unnest(generate_series(TIMESTAMP '{G.START}', TIMESTAMP '{G.END}', INTERVAL 6 HOUR)) AS t)),
x AS (SELECT c.system_id, t, max(observed_at) AS base_observed_at FROM c JOIN obs o ON o.system_id = c.system_id AND o.fetched_at <= t GROUP BY ALL) SELECT * FROM x WHERE base_observed_at >= t - INTERVAL 1 DAY""",
    "ref_01_neighbours": f"WITH {T.STATIONS}, {EDGES} SELECT * FROM edges",
    "ref_02_longest_prefix": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS address, url FROM pages), n AS (SELECT DISTINCT unnest([regexp_extract(url, '^https?://([^/]{1,4})', 1), regexp_extract(url, '^https?://([^/]{2})', 1)]) AS prefix FROM pages),
m AS (SELECT page_id, prefix, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) AS r FROM p JOIN n ON prefix <> '' AND starts_with(address, prefix))
SELECT p.page_id, m.prefix, length(m.prefix)::INT AS code FROM p LEFT JOIN m ON m.page_id = p.page_id AND r = 1""",
    "ref_03_daily_capacity": f"WITH {DAYMAX} SELECT * FROM dm",
    "ref_04_capacity_estimate": f"WITH {DAYMAX} SELECT * FROM ce",
    "ref_05_edition": f"""WITH {DAYMAX}, {T.STATIONS}, l AS (SELECT system_id, station_id, min(observed_at) AS first_seen_at FROM obs GROUP BY ALL)
SELECT l.system_id, l.station_id, first_seen_at, lat, lon, capacity, ce.capacity_est, days_used, s.station_id IS NOT NULL AS has_attributes FROM l LEFT JOIN stations s ON s.system_id = l.system_id AND s.station_id = l.station_id AND NOT geo_suspect
LEFT JOIN ce ON ce.system_id = l.system_id AND ce.station_id = l.station_id AND ce.day = DATE '2024-01-20'""",
    "ref_06_weather_cells": f"WITH {T.STATIONS} SELECT round_even(lat / 0.05, 0)::INT AS lat_idx, round_even(lon / 0.0625, 0)::INT AS lon_idx, count(*) AS n_ports FROM stations WHERE NOT geo_suspect GROUP BY ALL",
    "ref_07_activity": f"""WITH {T.OBS}, s AS (SELECT DISTINCT system_id, station_id FROM obs), dd AS (SELECT system_id, station_id, date_trunc('day', observed_at)::TIMESTAMP AS seen_at, arg_min(bikes, observed_at) AS b FROM obs GROUP BY ALL)
SELECT s.system_id, s.station_id, max(seen_at) AS last_seen_at, coalesce(max(seen_at) >= TIMESTAMP '2024-01-20 06:00:00' - INTERVAL 36 HOUR, false) AS is_active FROM s LEFT JOIN dd ON dd.system_id = s.system_id AND dd.station_id = s.station_id AND b <> -1 AND seen_at >= TIMESTAMP '2024-01-20 06:00:00' - INTERVAL 72 HOUR GROUP BY ALL""",
    "pro_01_daily": f"WITH {STATE}, {FLOW}, {PROFILE} SELECT * FROM daily",
    "pro_02_roll": f"""WITH {STATE}, {FLOW}, {PROFILE} {_sum("day BETWEEN DATE '2024-01-02' AND DATE '2024-01-29'")}""",
    "pro_03_serving_cells": f"""WITH {T.OBS}, {G.GRID}, {EVENT_DAYS}, x AS (SELECT DISTINCT t, (hour(t + INTERVAL 9 HOUR) * 60)::INT AS m, (t + INTERVAL 9 HOUR)::DATE AS date, h FROM points, (SELECT unnest([360, 720, 1440]) AS h))
SELECT DISTINCT t, CASE WHEN m + h >= 1440 THEN b.dow_type ELSE a.dow_type END AS dow_type, (((m + h) % 1440) // 360)::INT AS slot15 FROM x JOIN edays a ON a.date = x.date JOIN edays b ON b.date = x.date + 1""",
    "pro_03_edition": f"""WITH {T.OBS}, d AS (SELECT DISTINCT (observed_at + INTERVAL 9 HOUR)::DATE AS day FROM obs) SELECT d.day, max(e.day) AS edition FROM d LEFT JOIN d e ON day(e.day) % 3 = 0 AND e.day BETWEEN d.day - 2 AND d.day - 1 GROUP BY 1""",
    "pro_04_summary": f"""WITH {STATE}, {FLOW}, {PROFILE}, {PROF} SELECT dow_type, count(*) AS n_cells, count(*) FILTER (n_days >= CASE dow_type WHEN 'weekday' THEN 3 ELSE 2 END) AS n_served, count(DISTINCT (system_id, station_id)) AS n_ports, max(n_days) AS max_days, round(sum(n_suspended) / sum(n)::DOUBLE, 9) AS suspended_share FROM prof GROUP BY ALL""",
}
