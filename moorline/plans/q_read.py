"""Queries of serving and of monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.config import SPARSE
from moorline.operators import ingest, reference, timegrid
from moorline.operators import monitors as MON
from moorline.operators import serving as S
from moorline.plans import q_features as Q
from moorline.plans import q_ingest as I
from moorline.sources import tables as T

KEYS = S.KEYS
NOW = "2024-01-25 12:00:00"


def now():  # noqa: ANN201
    return F.to_timestamp_ntz(F.lit(NOW))


def view(spark: SparkSession, d: str) -> DataFrame:
    """Everything that serving shows of a station now. Stations unseen for a day are absent; a system is active while it is seen in the last week of the table."""
    o = T.obs_long(spark, d)
    latest = ingest.latest_of_history(o).withColumn("is_present", F.col("observed_at") >= now() - F.expr("INTERVAL 1 DAY"))
    systems = o.groupBy("system_id").agg((F.max("observed_at") >= now() - F.expr("INTERVAL 7 DAYS")).alias("is_active")).withColumn("capacity_is_dynamic", F.col("system_id").isin(*SPARSE.dynamic_systems))
    a = T.stations(spark, d).select(*KEYS, "name", "lat", "lon", "capacity", "geo_suspect")
    est = reference.capacity_estimate(reference.daily_capacity_max(o, F.to_date("observed_at")))
    est = est.groupBy(*KEYS).agg(F.max_by(F.struct("capacity_est", "days_used"), "day").alias("e")).select(*KEYS, "e.capacity_est", F.col("e.days_used").alias("capacity_days"))
    f = forecasts(spark, d).withColumn("base_observed_at", F.col("generated_at") - F.expr("INTERVAL 2 MINUTES")).withColumn("model_version", F.lit("v1"))
    return S.current_stations(latest, systems, a, est, f)


def all_stations(spark: SparkSession, d: str) -> DataFrame:
    """Every station with a state that follows from its id, for map queries that need many points."""
    s = T.stations(spark, d).where(~F.col("geo_suspect"))
    k = F.col("station_id").cast("long")
    return s.select(*KEYS, "lat", "lon", (k % 21).cast("int").alias("bikes"), (k % 17).cast("int").alias("docks"), (k % 23 != 0).alias("is_present"))


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    s = T.stations(spark, d).where(~F.col("geo_suspect"))
    k = F.col("station_id").cast("long")
    arr = lambda m: F.array(*[((k * m + h * 7) % 1001).cast("int") for h in (5, 30, 60, 180)])
    return s.select(*KEYS, F.array(*[F.lit(h) for h in (5, 30, 60, 180)]).alias("horizons_min"), arr(13).alias("p_bike_x1000"), arr(29).alias("p_dock_x1000"), (k % 3 + 1).cast("int").alias("confidence"), (now() - F.make_dt_interval(secs=k % 1200)).alias("generated_at"))


def fresh():  # noqa: ANN201
    return S.is_fresh(MON.age_s(now(), F.col("generated_at")))


def qry_01_current(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d)


def qry_02_box(spark: SparkSession, d: str) -> DataFrame:
    return S.query_box(all_stations(spark, d), 139.02, 35.0, 139.08, 35.05).select(*KEYS, "lat", "lon")


def qry_03_plan(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of different sizes around stations: snapped, and what would answer them."""
    s = T.stations(spark, d)
    side = (F.col("station_id").cast("long") % 9) * 0.0625
    c = S.plan_columns(F.col("lon") - side, F.col("lat") - side, F.col("lon") + side, F.col("lat") + side)
    return s.select(*KEYS, *[v.alias(k) for k, v in c.items()])


def qry_04_cells(spark: SparkSession, d: str) -> DataFrame:
    return S.cells(all_stations(spark, d), 0.05, forecasts(spark, d), [5, 30, 60, 180], fresh())


def qry_05_interpolate(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).withColumn("at", F.explode(F.array(*[F.lit(x) for x in (0, 5, 12, 45, 180, 200)])))
    p = S.interpolate(F.col("horizons_min"), F.col("p_bike_x1000"), S.forecast_horizon(F.col("at"), F.col("confidence") - 2))
    return f.select(*KEYS, "at", F.when(fresh(), p).alias("p"))


def qry_06_freshness(spark: SparkSession, d: str) -> DataFrame:
    x = ingest.latest_of_history(T.obs_long(spark, d))
    a = MON.age_s(now(), F.col("observed_at"))
    return x.select(*KEYS, S.stale_after(F.lit(3600), F.col("docks") * 600).alias("limit_s"), S.is_stale(a, F.lit(3600), F.col("docks") * 600).alias("is_stale"))


def qry_07_trips(spark: SparkSession, d: str) -> DataFrame:
    s = T.stations(spark, d).where(~F.col("geo_suspect")).select("system_id", "station_id")
    k = F.col("station_id").cast("long")
    pairs = s.select("system_id", F.col("station_id").alias("from_id"), ((k * 7 + 3) % 900).cast("string").alias("to_id"), (k % 100).cast("int").alias("depart_min"))
    return S.trips(pairs, forecasts(spark, d), T.stations(spark, d).select(*KEYS, "lat", "lon"))


def qry_08_alternatives(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).select(*KEYS, F.element_at("p_bike_x1000", 2).alias("p30"))
    return S.alternatives(Q.edges(spark, d), f, "p30")


def qry_09_detail_hours(spark: SparkSession, d: str) -> DataFrame:
    """The last days' hourly rows of each station."""
    h = S.hourly_rollup(T.obs_long(spark, d), now())
    return h.where(F.col("hour_start") >= now() - F.expr("INTERVAL 72 HOURS")).select(*KEYS, "hour_start", "n", F.round("bikes_mean", 6).alias("bikes_mean"))


def qry_09_week_trend(spark: SparkSession, d: str) -> DataFrame:
    s = T.stations(spark, d)
    k = F.col("station_id").cast("int")
    t = s.select(*KEYS, F.date_sub(F.to_date(F.lit("2024-01-20")), k % 10).alias("profile_date"), F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (i * 3 + k) % 1001).alias("p_x1000"))
    return S.week_trend(t, Q.event_days(spark, d), "2024-01-20").withColumn("hours", F.array_join("hours", ","))


def qry_10_rollup(spark: SparkSession, d: str) -> DataFrame:
    h = S.hourly_rollup(T.obs_long(spark, d), now())
    return h.select(*KEYS, "hour_start", "n", F.round("bikes_mean", 6).alias("bikes_mean"), F.round("docks_mean", 6).alias("docks_mean"))


def qry_11_unbounded(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "part")
    return p.select("p_partkey", S.is_unbounded(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice").cast("int")), limit=1000).alias("is_unbounded"))


def qry_12_feeds(spark: SparkSession, d: str) -> DataFrame:
    o = T.obs_long(spark, d).where(F.col("fetched_at") <= now())
    f = forecasts(spark, d).groupBy("system_id").agg(F.max("generated_at").alias("generated_at"), F.max_by("confidence", F.struct("generated_at", F.col("station_id").cast("long"))).alias("version"))
    x = o.groupBy("system_id").agg(F.max("observed_at").alias("observed_at"), F.max_by("station_id", F.struct("observed_at", "fetched_at")).alias("last_station"))
    return x.join(f, "system_id").withColumn("is_stale", S.is_stale(MON.age_s(now(), F.col("observed_at")), F.lit(300), F.lit(60)))


def heads(spark: SparkSession, d: str) -> DataFrame:
    o = T.obs_long(spark, d)
    return o.groupBy("system_id", F.date_trunc("hour", F.col("observed_at")).cast("timestamp_ntz").alias("observed_at")).agg(F.count_distinct("station_id").alias("n")).withColumn("is_anomalous", F.col("n") % 5 == 0)


def mon_01_daily_quality(spark: SparkSession, d: str) -> DataFrame:
    systems = T.obs_long(spark, d).select("system_id").distinct().withColumn("cadence_s", F.when(F.col("system_id") == "a", 3600).otherwise(5400))
    return MON.daily_quality(systems, heads(spark, d), T.job_runs(spark, d).where("status = 'failed'"))


def mon_02_stalled(spark: SparkSession, d: str) -> DataFrame:
    j = ingest.consecutive_errors(T.job_runs(spark, d).where(F.col("started_at") <= now()), ["job"], ["started_at", "run_id"], F.col("status") != "failed")
    s = j.groupBy(F.col("job").alias("system_id")).agg(F.max_by("consecutive_errors", F.struct("started_at", "run_id")).alias("consecutive_errors"), F.max("started_at").alias("last_attempt_at"), F.max(F.when(F.col("status") == "ok", F.col("started_at"))).alias("last_observed_at"))
    return MON.stalled(s.withColumn("cadence_s", F.lit(1200)).withColumn("poll_s", F.lit(600)), now(), 2, 3600)


def mon_03_count_shift(spark: SparkSession, d: str) -> DataFrame:
    return MON.count_shift(heads(spark, d).where(F.col("observed_at") <= now()), now())


def mon_04_anomalous(spark: SparkSession, d: str) -> DataFrame:
    return heads(spark, d).where(F.col("is_anomalous") & F.col("observed_at").between(now() - F.expr("INTERVAL 24 HOURS"), now())).groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), F.max("observed_at").alias("last_at"))


def registry(spark: SparkSession, d: str) -> DataFrame:
    j = T.job_runs(spark, d)
    extra = j.select(F.concat("job", F.lit("-new")).alias("job")).distinct().withColumn("registered_at", now() - F.expr("INTERVAL 10 MINUTES"))
    r = j.groupBy("job").agg(F.min("started_at").alias("registered_at")).unionByName(extra)
    return r.withColumn("window_s", F.when(F.col("job").startswith("c"), 1200).otherwise(7200))


def mon_05_missing(spark: SparkSession, d: str) -> DataFrame:
    return MON.jobs_missing(registry(spark, d), T.job_runs(spark, d).where(F.col("started_at") <= now()), now())


def mon_06_failed(spark: SparkSession, d: str) -> DataFrame:
    return MON.jobs_failed(T.job_runs(spark, d), now(), 6)


def mon_07_stuck(spark: SparkSession, d: str) -> DataFrame:
    return MON.jobs_stuck(T.job_runs(spark, d).where(F.col("started_at") <= now()), now())


def mon_08_inference(spark: SparkSession, d: str) -> DataFrame:
    j = T.job_runs(spark, d).where(F.col("started_at") <= now())
    return MON.inference_health(j, j.where("run_id % 10 <> 0").select("run_id"), now())


def mon_09_stale_tables(spark: SparkSession, d: str) -> DataFrame:
    o = T.obs_long(spark, d).where(F.col("fetched_at") <= now())
    a = MON.freshness(o.where("system_id = 'a'"), "fetched_at", now(), 1200, "weather")
    return a.unionByName(MON.freshness(T.read(spark, d, "orders").select(F.col("o_orderdate").alias("at")), "at", now(), 90 * 86400, "holidays"))


def mon_10_model_age(spark: SparkSession, d: str) -> DataFrame:
    o = T.obs_long(spark, d)
    m = o.groupBy(F.concat(F.lit("m"), (F.col("station_id").cast("long") % 40).cast("string")).alias("model")).agg(F.collect_set(F.to_date("observed_at")).alias("train_days"))
    return MON.model_age(m, "2024-01-31")


def mon_11_shadow(spark: SparkSession, d: str) -> DataFrame:
    j = T.job_runs(spark, d).withColumn("system_id", F.col("job")).withColumn("healthy", F.when(F.col("run_id") % 5 != 0, F.col("run_id") % 2 == 0))
    return MON.shadow_failing(j).withColumn("runs", F.array_join("runs", ","))


def mon_12_suppress(spark: SparkSession, d: str) -> DataFrame:
    j = T.job_runs(spark, d).where("status = 'failed'")
    return MON.suppress(j, "job", "started_at", 86400)


def mon_13_job_sets(spark: SparkSession, d: str) -> DataFrame:
    j = T.job_runs(spark, d)
    actual = j.where("run_id % 2 = 0").groupBy(F.concat("job", F.when(F.col("run_id") % 3 == 0, F.lit("-x")).otherwise(F.lit(""))).alias("job")).agg((F.max("run_id") % 4 != 0).alias("is_active"))
    return MON.job_sets(registry(spark, d).select("job"), actual)


QUERIES = {n: f for n, f in list(globals().items()) if n[:4] in ("qry_", "mon_")}

TS = f"TIMESTAMP '{NOW}'"
LATEST = f"""{T.OBS}, {T.STATIONS}, hh AS (SELECT *, lag(struct_pack(bikes, docks, flags)) OVER (PARTITION BY system_id, station_id ORDER BY observed_at, fetched_at) AS p FROM obs),
latest AS (SELECT system_id, station_id, max(observed_at) AS observed_at, arg_max(bikes, observed_at) AS bikes, arg_max(docks, observed_at) AS docks, arg_max(flags, observed_at) AS flags FROM hh GROUP BY ALL)"""
FORE = f"""{T.STATIONS}, fore AS (SELECT system_id, station_id, lat, lon, station_id::BIGINT AS k, [5, 30, 60, 180] AS hs, list_transform([5, 30, 60, 180], lambda h: ((station_id::BIGINT * 13 + h * 7) % 1001)::INT) AS pb, list_transform([5, 30, 60, 180], lambda h: ((station_id::BIGINT * 29 + h * 7) % 1001)::INT) AS pd,
  (station_id::BIGINT % 3 + 1)::INT AS confidence, {TS} - to_seconds(station_id::BIGINT % 1200) AS generated_at FROM stations WHERE NOT geo_suspect)"""


def _ip(p: str, at: str) -> str:
    seg = lambda a, b, i: f"WHEN {at} <= {b} THEN {p}[{i}] + ({p}[{i + 1}] - {p}[{i}]) * ({at} - {a}) / {b - a}::DOUBLE"
    return f"(floor((CASE WHEN {at} <= 5 THEN {p}[1]::DOUBLE {seg(5, 30, 1)} {seg(30, 60, 2)} {seg(60, 180, 3)} ELSE {p}[4] END) + 0.5) / 1000)"


HEADS = f"{T.OBS}, heads AS (SELECT system_id, date_trunc('hour', observed_at)::TIMESTAMP AS observed_at, count(DISTINCT station_id) AS n, count(DISTINCT station_id) % 5 = 0 AS is_anomalous FROM obs GROUP BY ALL)"
REG = f"""{T.JOBS}, reg AS (SELECT job, registered_at, CASE WHEN starts_with(job, 'c') THEN 1200 ELSE 7200 END AS window_s FROM (SELECT job, min(started_at) AS registered_at FROM jobs GROUP BY 1 UNION ALL SELECT DISTINCT job || '-new', {TS} - INTERVAL 10 MINUTE FROM jobs))"""
ROLL = f"{T.OBS}, roll0 AS (SELECT system_id, station_id, date_trunc('hour', observed_at)::TIMESTAMP AS hour_start, count(*) AS n, round(avg(bikes), 6) AS bikes_mean, round(avg(docks), 6) AS docks_mean FROM obs WHERE bikes >= 0 AND docks >= 0 GROUP BY ALL), roll AS (SELECT * FROM roll0 WHERE hour_start + INTERVAL 1 HOUR <= {TS})"

ORACLE = {
    "qry_01_current": f"""WITH {T.OBS}, {FORE}, hh AS (SELECT *, lag(struct_pack(bikes, docks, flags)) OVER (PARTITION BY system_id, station_id ORDER BY observed_at, fetched_at) AS p FROM obs),
latest AS (SELECT system_id, station_id, max(observed_at) AS observed_at, arg_max(bikes, observed_at) AS bikes, arg_max(docks, observed_at) AS docks, arg_max(flags, observed_at) AS flags, max(observed_at) FILTER (p IS NULL OR p <> struct_pack(bikes, docks, flags)) AS last_changed_at FROM hh GROUP BY ALL),
act AS (SELECT system_id FROM obs GROUP BY 1 HAVING max(observed_at) >= {TS} - INTERVAL 7 DAY), dmx AS (SELECT system_id, station_id, observed_at::DATE AS day, max(bikes + docks) AS m FROM obs WHERE bikes <> -1 AND docks <> -1 GROUP BY ALL),
top AS (SELECT system_id, station_id, max(day) AS top FROM dmx GROUP BY ALL), est AS (SELECT d.system_id, d.station_id, max(m)::INT AS capacity_est, count(*)::INT AS capacity_days FROM dmx d JOIN top t ON t.system_id = d.system_id AND t.station_id = d.station_id WHERE d.day > t.top - 7 GROUP BY ALL)
SELECT l.system_id, l.station_id, s.name, s.lat, s.lon, CASE WHEN l.system_id <> 'b' THEN s.capacity END AS capacity, nullif(bikes, -1) AS bikes, nullif(docks, -1) AS docks, (flags & 1) > 0 AS is_installed, (flags & 2) > 0 AS is_renting, (flags & 4) > 0 AS is_returning, l.observed_at >= {TS} - INTERVAL 1 DAY AS is_present, last_changed_at,
  CASE WHEN f.k IS NOT NULL THEN f.hs END AS forecast_horizons_min, f.pb AS forecast_p_bike_x1000, f.pd AS forecast_p_dock_x1000, f.confidence AS forecast_confidence, f.generated_at - INTERVAL 2 MINUTE AS forecast_base_observed_at, CASE WHEN f.k IS NOT NULL THEN 'v1' END AS forecast_model_version, f.generated_at AS forecast_generated_at, e.capacity_est, e.capacity_days
FROM latest l JOIN act USING (system_id) LEFT JOIN stations s ON s.system_id = l.system_id AND s.station_id = l.station_id LEFT JOIN est e ON e.system_id = l.system_id AND e.station_id = l.station_id LEFT JOIN fore f ON f.system_id = l.system_id AND f.station_id = l.station_id WHERE NOT coalesce(s.geo_suspect, false)""",
    "qry_02_box": f"WITH {T.STATIONS} SELECT system_id, station_id, lat, lon FROM stations WHERE NOT geo_suspect AND lat BETWEEN 35.0 AND 35.05 AND lon BETWEEN 139.02 AND 139.08",
    "qry_03_plan": f"""WITH {T.STATIONS}, b AS (SELECT *, (station_id::BIGINT % 9) * 0.0625::DOUBLE AS d FROM stations), e AS (SELECT *, round(greatest((lon + d) - (lon - d), (lat + d) - (lat - d)), 9) AS side FROM b)
SELECT system_id, station_id, round(floor(round((lon - d) / 0.01, 9)) * 0.01, 9) AS w, round(floor(round((lat - d) / 0.01, 9)) * 0.01, 9) AS s, round(ceil(round((lon + d) / 0.01, 9)) * 0.01, 9) AS e, round(ceil(round((lat + d) / 0.01, 9)) * 0.01, 9) AS n,
  CASE WHEN side <= 0.08 THEN 'stations' WHEN side <= 0.25 THEN 'cells_0.01' WHEN side <= 0.5 THEN 'cells_0.05' ELSE 'refuse' END AS plan FROM e""",
    "qry_04_cells": f"""WITH {FORE}, v AS (SELECT *, floor(round(lat / 0.05, 9))::INT AS cy, floor(round(lon / 0.05, 9))::INT AS cx, k % 21 AS b, k % 17 AS d, k % 23 <> 0 AS here FROM fore),
a AS (SELECT cy, cx, count(*) AS n, coalesce(sum(b) FILTER (here), 0)::BIGINT AS bikes, coalesce(sum(d) FILTER (here), 0)::BIGINT AS docks, bool_or(NOT here) AS is_stale FROM v GROUP BY ALL),
f AS (SELECT cy, cx, [max(pb[1]), max(pb[2]), max(pb[3]), max(pb[4])] AS p_bike_x1000, count(*) AS n_forecast, max(confidence) AS confidence, min(generated_at) AS generated_at FROM v WHERE k % 1200 <= 900 GROUP BY ALL)
SELECT a.*, p_bike_x1000, coalesce(n_forecast, 0) AS n_forecast, confidence, generated_at FROM a LEFT JOIN f USING (cy, cx)""",
    "qry_05_interpolate": f"WITH {FORE}, x AS (SELECT *, unnest([0, 5, 12, 45, 180, 200]) AS at_min FROM fore), y AS (SELECT *, at_min + greatest(confidence - 2, 0) AS q FROM x) SELECT system_id, station_id, at_min AS \"at\", CASE WHEN k % 1200 <= 900 THEN {_ip('pb', 'q')} END AS p FROM y",
    "qry_06_freshness": f"WITH {LATEST} SELECT system_id, station_id, (3 * greatest(3600, docks * 600) + docks * 600)::INT AS limit_s, floor((epoch_us({TS}) - epoch_us(observed_at)) / 1000000) > 3 * greatest(3600, docks * 600) + docks * 600 AS is_stale FROM latest",
    "qry_07_trips": f"""WITH {FORE}, t AS (SELECT a.system_id, a.station_id AS from_id, b.station_id AS to_id, (a.k % 100)::INT AS depart_min, a.pb, b.pd, least(a.confidence, b.confidence) AS c, {Q.HAV} AS dist FROM fore a JOIN fore b ON b.system_id = a.system_id AND b.station_id = ((a.k * 7 + 3) % 900)::VARCHAR),
r AS (SELECT *, round(dist / (14.0 * 1000 / 60)::DOUBLE)::INT AS ride_min FROM t), z AS (SELECT *, depart_min + ride_min AS arrive_min FROM r)
SELECT system_id, from_id, to_id, depart_min, ride_min, arrive_min, CASE WHEN arrive_min <= 180 THEN round({_ip('pb', 'depart_min')} * {_ip('pd', 'arrive_min')}, 3) END AS p_trip, CASE WHEN arrive_min <= 180 THEN c END AS confidence, arrive_min > 180 AS refused FROM z""",
    "qry_08_alternatives": f"""WITH {FORE}, {Q.EDGES}, x AS (SELECT e.system_id, e.station_id, row_number() OVER (PARTITION BY e.system_id, e.station_id ORDER BY pb[2] DESC, distance_m, nb_station_id)::INT AS rank, nb_station_id, pb[2] AS p, distance_m
  FROM edges e JOIN fore f ON f.system_id = nb_system_id AND f.station_id = nb_station_id WHERE same_system AND distance_m <= 400) SELECT * FROM x WHERE rank <= 5""",
    "qry_09_detail_hours": f"WITH {ROLL} SELECT system_id, station_id, hour_start, n, bikes_mean FROM roll WHERE hour_start >= {TS} - INTERVAL 72 HOUR",
    "qry_09_week_trend": f"""WITH {T.STATIONS}, {Q.EVENT_DAYS}, d AS (SELECT date, CASE dow_type WHEN 'sat' THEN 0 WHEN 'sun_holiday' THEN 1 ELSE 2 END AS k FROM edays WHERE date BETWEEN DATE '2024-01-20' AND DATE '2024-01-26')
SELECT system_id, station_id, date, CASE WHEN station_id::INT % 10 <= 7 THEN array_to_string(list_transform(range(k * 24, k * 24 + 24), lambda i: (i * 3 + station_id::INT) % 1001), ',') END AS hours FROM stations, d""",
    "qry_10_rollup": f"WITH {ROLL} SELECT * FROM roll",
    "qry_11_unbounded": "SELECT p_partkey, coalesce(greatest(CASE WHEN p_partkey % 3 = 0 THEN p_size END, CASE WHEN p_partkey % 2 = 0 THEN trunc(p_retailprice)::INT END) >= 1000, false) AS is_unbounded FROM part",
    "qry_12_feeds": f"""WITH {T.OBS}, {FORE}, x AS (SELECT system_id, max(observed_at) AS observed_at, arg_max(station_id, observed_at) AS last_station FROM obs WHERE fetched_at <= {TS} GROUP BY 1),
f AS (SELECT system_id, max(generated_at) AS generated_at, arg_max(confidence, struct_pack(g := generated_at, k := k)) AS version FROM fore GROUP BY 1) SELECT *, floor((epoch_us({TS}) - epoch_us(observed_at)) / 1000000) > 960 AS is_stale FROM x JOIN f USING (system_id)""",
    "mon_01_daily_quality": f"""WITH {HEADS}, {T.JOBS}, s AS (SELECT *, (observed_at + INTERVAL 9 HOUR)::DATE AS day FROM heads), g AS (SELECT *, epoch(lead(observed_at) OVER (PARTITION BY system_id, day ORDER BY observed_at)) - epoch(observed_at) AS gap FROM s),
p AS (SELECT system_id, day, count(*) AS n, max(gap)::BIGINT AS g, count(*) FILTER (is_anomalous) AS a FROM g GROUP BY ALL), e AS (SELECT system_id, (started_at + INTERVAL 9 HOUR)::DATE AS day, count(*) AS n FROM jobs WHERE status = 'failed' GROUP BY ALL)
SELECT q.system_id, d.day, 86400 // CASE WHEN q.system_id = 'a' THEN 3600 ELSE 5400 END AS n_expected, coalesce(p.n, 0) AS n_snapshots, p.g AS max_gap_s, coalesce(p.a, 0) AS n_anomalies, coalesce(e.n, 0) AS n_errors
FROM (SELECT DISTINCT day FROM s) d CROSS JOIN (SELECT DISTINCT system_id FROM obs) q LEFT JOIN p ON p.system_id = q.system_id AND p.day = d.day LEFT JOIN e ON e.system_id = q.system_id AND e.day = d.day""",
    "mon_02_stalled": f"""WITH {T.JOBS}, j AS (SELECT *, sum((status <> 'failed')::INT) OVER (PARTITION BY job ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS g FROM jobs WHERE started_at <= {TS}),
c AS (SELECT *, sum((status = 'failed')::INT) OVER (PARTITION BY job, g ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS e FROM j), s AS (SELECT job AS system_id, arg_max(e, started_at) AS e, max(started_at) AS la, max(started_at) FILTER (status = 'ok') AS lo FROM c GROUP BY 1)
SELECT system_id, 'stalled' AS alert FROM s WHERE coalesce(epoch_us({TS}) - epoch_us(lo) >= 4201000000, true) UNION ALL SELECT system_id, 'errors' FROM s WHERE e >= 2 UNION ALL SELECT system_id, 'silent' FROM s WHERE coalesce(epoch_us({TS}) - epoch_us(la) >= 3601000000, true)""",
    "mon_03_count_shift": f"""WITH {HEADS}, a AS (SELECT system_id, arg_max(n, observed_at) AS n_now FROM heads WHERE observed_at <= {TS} GROUP BY 1), b AS (SELECT system_id, median(n)::DOUBLE AS n_before FROM heads WHERE observed_at BETWEEN {TS} - INTERVAL 25 HOUR AND {TS} - INTERVAL 23 HOUR GROUP BY 1)
SELECT *, round(abs(n_now - n_before) / n_before, 9) AS shift FROM a JOIN b USING (system_id) WHERE abs(n_now - n_before) / n_before > 0.05""",
    "mon_04_anomalous": f"WITH {HEADS} SELECT system_id, count(*) AS n, max(observed_at) AS last_at FROM heads WHERE is_anomalous AND observed_at BETWEEN {TS} - INTERVAL 24 HOUR AND {TS} GROUP BY 1",
    "mon_05_missing": f"""WITH {REG}, l AS (SELECT job, max(started_at) AS last_ok_at FROM jobs WHERE status = 'ok' AND started_at <= {TS} GROUP BY 1)
SELECT reg.job, last_ok_at FROM reg LEFT JOIN l USING (job) WHERE floor((epoch_us({TS}) - epoch_us(registered_at)) / 1000000) > window_s AND coalesce(floor((epoch_us({TS}) - epoch_us(last_ok_at)) / 1000000) > window_s, true)""",
    "mon_06_failed": f"WITH {T.JOBS} SELECT job, count(*) AS n, max(started_at) AS last_at, arg_max(error, started_at) AS last_error FROM jobs WHERE status = 'failed' AND started_at > {TS} - INTERVAL 6 HOUR AND started_at <= {TS} GROUP BY 1",
    "mon_07_stuck": f"WITH {T.JOBS} SELECT job, count(*) AS n, min(started_at) AS oldest, max(started_at) AS newest FROM jobs WHERE status = 'running' AND started_at <= {TS} AND floor((epoch_us({TS}) - epoch_us(started_at)) / 1000000) > 3600 GROUP BY 1",
    "mon_08_inference": f"""WITH {T.JOBS}, j AS (SELECT * FROM jobs WHERE started_at <= {TS}) SELECT system_id, max(started_at) FILTER (status = 'ok') AS last_ok_at, count(*) FILTER (status = 'running' AND floor((epoch_us({TS}) - epoch_us(started_at)) / 1000000) > 900) AS n_stuck,
  count(*) FILTER (status = 'ok' AND run_id % 10 = 0) AS n_unlogged, floor((epoch_us({TS}) - epoch_us(max(started_at) FILTER (status = 'ok'))) / 1000000) > 900 AS is_stale FROM j GROUP BY 1""",
    "mon_09_stale_tables": f"""WITH {T.OBS}, a AS (SELECT 'weather' AS what, max(fetched_at) AS newest, 1200 AS l FROM obs WHERE system_id = 'a' AND fetched_at <= {TS} UNION ALL SELECT 'holidays', max(o_orderdate), 90 * 86400 FROM orders) SELECT what, newest, floor((epoch_us({TS}) - epoch_us(newest)) / 1000000) > l AS fires FROM a""",
    "mon_10_model_age": f"WITH {T.OBS}, m AS (SELECT 'm' || (station_id::BIGINT % 40)::VARCHAR AS model, max(observed_at::DATE) AS last_day FROM obs GROUP BY 1) SELECT model, last_day, (DATE '2024-01-31' - last_day)::INT AS age_days, DATE '2024-01-31' - last_day >= 8 AS fires FROM m",
    "mon_11_shadow": f"""WITH {T.JOBS}, r AS (SELECT job AS system_id, run_id, started_at, CASE WHEN run_id % 5 <> 0 THEN run_id % 2 = 0 END AS h, row_number() OVER (PARTITION BY job ORDER BY started_at DESC, run_id DESC) AS n FROM jobs WHERE status = 'ok')
SELECT system_id, count(*) AS n, count(h) AS n_judged, count(*) FILTER (h) AS n_healthy, string_agg(run_id::VARCHAR, ',' ORDER BY started_at, run_id) AS runs, count(*) = 3 AND count(h) = 3 AND count(*) FILTER (h) = 0 AS fires FROM r WHERE n <= 3 GROUP BY 1""",
    "mon_12_suppress": f"""WITH RECURSIVE {T.JOBS}, f AS (SELECT job, started_at AS t FROM jobs WHERE status = 'failed'), s AS (SELECT job, min(t) AS t FROM f GROUP BY 1 UNION ALL SELECT s.job, (SELECT min(f.t) FROM f WHERE f.job = s.job AND f.t >= s.t + INTERVAL 1 DAY) AS t FROM s WHERE s.t IS NOT NULL) SELECT job, t AS sent_at FROM s WHERE t IS NOT NULL""",
    "mon_13_job_sets": f"""WITH {REG}, a AS (SELECT job || CASE WHEN run_id % 3 = 0 THEN '-x' ELSE '' END AS job, max(run_id) % 4 <> 0 AS is_active FROM jobs WHERE run_id % 2 = 0 GROUP BY 1)
SELECT coalesce(reg.job, a.job) AS job, CASE WHEN a.job IS NULL THEN 'missing' WHEN reg.job IS NULL THEN 'unmonitored' WHEN NOT is_active THEN 'inactive' END AS kind FROM reg FULL OUTER JOIN a ON a.job = reg.job WHERE a.job IS NULL OR reg.job IS NULL OR NOT is_active""",
}
