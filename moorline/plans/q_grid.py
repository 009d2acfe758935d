"""Queries of the time grid, as-of joins, labels, exclusions and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.config import SPARSE
from moorline.operators import asof, exclude, labels, sampling, timegrid
from moorline.plans.scratch import dealt
from moorline.sources import tables as T

START, END = "2024-01-02 00:00:00", "2024-01-29 00:00:00"
KEYS = list(asof.KEYS)
P = ["bikes", "docks", "flags"]

GRID = f"""points AS (SELECT * FROM (SELECT DISTINCT system_id, station_id FROM obs), (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL 6 HOUR, INTERVAL 6 HOUR)) AS t))"""
FEATURE = """feature AS (
  SELECT p.system_id, p.station_id, p.t, max(struct_pack(observed_at := o.observed_at, fetched_at := o.fetched_at, bikes := o.bikes, docks := o.docks, flags := o.flags)) FILTER (o.observed_at IS NOT NULL) AS seen
  FROM points p LEFT JOIN obs o ON o.system_id = p.system_id AND o.station_id = p.station_id AND o.fetched_at <= p.t GROUP BY ALL)"""
PAIRS = """pairs AS (
  SELECT f.system_id, f.station_id, f.t, h.h_min, f.t + to_minutes(h.h_min) AS target, f.seen,
    max(struct_pack(observed_at := o.observed_at, fetched_at := o.fetched_at, bikes := o.bikes, docks := o.docks, flags := o.flags)) FILTER (o.observed_at IS NOT NULL) AS truth
  FROM feature f CROSS JOIN (SELECT unnest([360, 720, 1440]) AS h_min) h
  LEFT JOIN obs o ON o.system_id = f.system_id AND o.station_id = f.station_id AND o.observed_at <= f.t + to_minutes(h.h_min) GROUP BY ALL)"""
BASE_REASON = """CASE WHEN seen IS NULL THEN 'no_asof_at_t' WHEN epoch_us(t) - epoch_us(seen.observed_at) > 86400000000 THEN 'stale_at_t'
  WHEN seen.bikes = -1 OR seen.docks = -1 THEN 'unobserved_at_t' WHEN NOT (seen.flags >= 0 AND (seen.flags & 2) > 0 AND (seen.flags & 4) > 0) THEN 'suspended_at_t' END"""
TARGET_REASON = """CASE WHEN truth IS NULL THEN 'no_asof_at_target' WHEN epoch_us(target) - epoch_us(truth.observed_at) > 86400000000 THEN 'stale_at_target'
  WHEN truth.bikes = -1 OR truth.docks = -1 THEN 'unobserved_at_target' WHEN seen.observed_at = truth.observed_at AND seen.fetched_at = truth.fetched_at THEN 'collision' END"""


def grid_points(spark: SparkSession, d: str, facts: DataFrame | None = None) -> DataFrame:
    """Observed entities at all grid times. With ``facts(keys, ...)`` those that it knows, with its columns, which join them before they grow: no estimate of size counts the grown rows."""
    entities = T.obs_long(spark, d).select(*KEYS).distinct()
    return timegrid.entity_grid(dealt(entities if facts is None else entities.join(facts.hint("merge"), KEYS), *KEYS), START, END, SPARSE.step_min)


def features(spark: SparkSession, d: str) -> DataFrame:
    return asof.as_of_feature(grid_points(spark, d), T.obs_long(spark, d), P)


def horizon_pairs(base: DataFrame, obs: DataFrame) -> DataFrame:
    """Base points times horizons with the truth at each target: one as-of pass for all horizons."""
    pairs = base.withColumn("h_min", F.explode(F.array(*[F.lit(h) for h in SPARSE.horizons_min]))).withColumn("target", F.col("t") + timegrid.minutes(F.col("h_min")))
    truth = asof.as_of_label(pairs.select(*KEYS, "target").distinct(), obs, P, t="target")
    return pairs.join(truth, [*KEYS, "target"])


def judged_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = features(spark, d).withColumn("base_reason", exclude.base_reason("seen", "t", SPARSE.staleness_s))
    pairs = horizon_pairs(points.where(F.col("base_reason").isNull()), T.obs_long(spark, d))
    return points, pairs.withColumn("target_reason", exclude.target_reason("truth", "target", SPARSE.staleness_s, "seen"))


def flagship_persistence_brier(spark: SparkSession, d: str) -> DataFrame:
    """How good is persistence at each horizon: Brier scores over all usable pairs."""
    _, pairs = judged_pairs(spark, d)
    kept = pairs.where(F.col("target_reason").isNull())
    for target, count in (("bike", "bikes"), ("dock", "docks")):
        y = getattr(labels, f"y_{target}")(F.col(f"truth.{count}"), F.col("truth.flags"))
        p = (F.col(f"seen.{count}") >= 1).cast("int")
        kept = kept.withColumn(f"e_{target}", (p - y) * (p - y)).withColumn(f"y_{target}", y)
    return kept.groupBy("system_id", "h_min").agg(
        F.count(F.lit(1)).alias("n"),
        *[x for t in ("bike", "dock") for x in (F.round(F.avg(f"e_{t}"), 9).alias(f"brier_{t}"), F.round(F.avg(f"y_{t}"), 9).alias(f"rate_{t}"))],
    )


def grd_01_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid_points(spark, d).groupBy("system_id", "t").agg(F.count(F.lit(1)).alias("n_points"))


def grd_02_local_time(spark: SparkSession, d: str) -> DataFrame:
    o = T.obs_long(spark, d)
    at = F.col("observed_at")
    return o.groupBy(timegrid.local_date(at, 9).alias("local_date"), timegrid.minute_of_day(at, 9).alias("minute_of_day")).agg(F.count(F.lit(1)).alias("n"), F.max(timegrid.floor_to(at, 5)).alias("last_step"))


def aso_01_feature_asof(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select(*KEYS, "t", "seen.observed_at", "seen.fetched_at", "seen.bikes", "seen.docks", "seen.flags")


def aso_02_label_asof(spark: SparkSession, d: str) -> DataFrame:
    x = asof.as_of_label(grid_points(spark, d), T.obs_long(spark, d), P)
    return x.select(*KEYS, "t", "truth.observed_at", "truth.fetched_at", "truth.bikes")


def aso_03_gather(spark: SparkSession, d: str) -> DataFrame:
    x = features(spark, d)
    return x.groupBy("t").agg(F.sum(asof.gather(x, "seen", "bikes")).alias("sum_bikes"), F.sum(asof.gather(x, "seen", "flags")).alias("sum_flags"))


def aso_04_unreferenced(spark: SparkSession, d: str) -> DataFrame:
    ledger = T.stations(spark, d).where(F.col("station_id").cast("long") % 5 != 0)
    return asof.unreferenced(T.obs_long(spark, d), ledger)


def aso_05_validity(spark: SparkSession, d: str) -> DataFrame:
    x = features(spark, d).withColumn("valid", asof.valid("seen", "t", SPARSE.staleness_s))
    return x.groupBy(*KEYS).agg(F.count_if("valid").alias("n_valid"), F.count(F.lit(1)).alias("n_points"))


def aso_06_aligned(spark: SparkSession, d: str) -> DataFrame:
    x = asof.aligned(T.obs_long(spark, d), T.stations(spark, d))
    return x.groupBy(*KEYS).agg(F.count("observed_at").alias("n_rows"), F.max("observed_at").alias("last_at"))


def lbl_01_labels(spark: SparkSession, d: str) -> DataFrame:
    o = T.obs_long(spark, d)
    flags = F.when(F.col("bikes") == -1, -1).otherwise(F.col("flags"))
    o = o.withColumn("y_bike", labels.y_bike(F.col("bikes"), flags)).withColumn("y_dock", labels.y_dock(F.col("docks"), flags))
    return o.select(*KEYS, "observed_at", "y_bike", "y_dock")


def lbl_02_collisions(spark: SparkSession, d: str) -> DataFrame:
    base = features(spark, d).where(F.col("seen").isNotNull())
    pairs = horizon_pairs(base, T.obs_long(spark, d))
    return pairs.groupBy("system_id", "h_min").agg(F.count_if(labels.collision("seen", "truth")).alias("n_collisions"), F.count(F.lit(1)).alias("n_pairs"))


def exc_01_base(spark: SparkSession, d: str) -> DataFrame:
    x = features(spark, d).withColumn("reason", F.coalesce(exclude.base_reason("seen", "t", SPARSE.staleness_s, phantom=F.col("station_id").cast("long") % 29 == 0), F.lit("kept")))
    return x.groupBy("system_id", "reason").agg(F.count(F.lit(1)).alias("n_points"))


def exc_02_target(spark: SparkSession, d: str) -> DataFrame:
    _, pairs = judged_pairs(spark, d)
    return pairs.groupBy("system_id", "h_min", F.coalesce("target_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n_pairs"))


def exc_03_accounting(spark: SparkSession, d: str) -> DataFrame:
    points, pairs = judged_pairs(spark, d)
    return exclude.account(points, pairs, len(SPARSE.horizons_min), ["system_id"])


def drawn_points(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.col("t"), len(SPARSE.horizons_min)
    index = F.floor(timegrid.minute_of_day(t, 9) / SPARSE.step_min)
    return sampling.with_draws(grid_points(spark, d), timegrid.local_date(t, 9), [F.col(k) for k in KEYS], index, n, SPARSE.sample_rate)


def smp_01_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn (point, horizon) pairs."""
    x = drawn_points(spark, d).select(*KEYS, "t", F.explode(F.arrays_zip(F.array(*[F.lit(h) for h in SPARSE.horizons_min]).alias("h_min"), F.col("_draws").alias("drawn"))).alias("z"))
    return x.select(*KEYS, "t", "z.h_min", "z.drawn").where("drawn").drop("drawn")


def smp_02_weights(spark: SparkSession, d: str) -> DataFrame:
    """All pairs, and the weights of the drawn ones, which come to about as many."""
    x = sampling.with_weight(drawn_points(spark, d), SPARSE.sample_rate)
    kept = F.size(F.filter("_draws", lambda drawn: drawn)) * F.col("weight")
    return x.groupBy("system_id").agg(F.sum(F.size("_draws")).cast("long").alias("n_pairs"), F.sum(kept).alias("sum_weight"))


def smp_03_splitmix(spark: SparkSession, d: str) -> DataFrame:
    """Share kept by the splitmix64 sampler, by event type."""
    e = T.read(spark, d, "events")
    e = sampling.with_uniforms(e, [F.col("user_id").cast("long") * 1_000_003 + F.col("event_id")], "u")
    return e.withColumn("kept", (F.col("u")[0] < 0.25).cast("int")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("kept").alias("n_kept"))


def spl_01_split(spark: SparkSession, d: str) -> DataFrame:
    days = T.obs_long(spark, d).select(timegrid.local_date(F.col("observed_at"), 9).alias("day"))
    return sampling.split_days(days, 5, 1)


def spl_02_window(spark: SparkSession, d: str) -> DataFrame:
    """A window that begins before the first day: missing days are told."""
    days = T.obs_long(spark, d).select(timegrid.local_date(F.col("observed_at"), 9).alias("day"))
    return sampling.window_days(days, "2024-01-28", 35)


_NAMES = """flagship_persistence_brier grd_01_grid grd_02_local_time aso_01_feature_asof aso_02_label_asof aso_03_gather aso_04_unreferenced aso_05_validity aso_06_aligned
lbl_01_labels lbl_02_collisions exc_01_base exc_02_target exc_03_accounting smp_01_sample smp_02_weights smp_03_splitmix spl_01_split spl_02_window""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_JUDGED = f"""WITH {T.OBS}, {GRID}, {FEATURE}, judged AS (SELECT *, {BASE_REASON} AS base_reason FROM feature),
pairs0 AS (SELECT f.system_id, f.station_id, f.t, h.h_min, f.t + to_minutes(h.h_min) AS target, f.seen,
    max(struct_pack(observed_at := o.observed_at, fetched_at := o.fetched_at, bikes := o.bikes, docks := o.docks, flags := o.flags)) FILTER (o.observed_at IS NOT NULL) AS truth
  FROM judged f CROSS JOIN (SELECT unnest([360, 720, 1440]) AS h_min) h
  LEFT JOIN obs o ON o.system_id = f.system_id AND o.station_id = f.station_id AND o.observed_at <= f.t + to_minutes(h.h_min) WHERE f.base_reason IS NULL GROUP BY ALL),
pairs AS (SELECT *, {TARGET_REASON} AS target_reason FROM pairs0)"""



def _times(z: str, c: int) -> str:
    """z * c modulo 2**64 in 128-bit arithmetic, from halves of 32 bits."""
    low, high = c & 0xFFFFFFFF, c >> 32
    return f"((((({z} // 4294967296) * {low} + ({z} % 4294967296) * {high}) % 4294967296) * 4294967296 + ({z} % 4294967296) * {low}) % 18446744073709551616)"


def _shifted(z: str, n: int) -> str:
    return f"xor({z}::UBIGINT, {z}::UBIGINT >> {n})::HUGEINT"


def splitmix_sql(source: str, keep: str, state: str) -> str:
    """CTEs a to f over a source: its columns ``keep``, and z, the 64 bits of splitmix64 of a state."""
    return f"""a AS (SELECT {keep}, (({state}) + {0x9E3779B97F4A7C15}::HUGEINT) % 18446744073709551616 AS z FROM {source}),
b AS (SELECT {keep}, {_shifted('z', 30)} AS z FROM a), c AS (SELECT {keep}, {_times('z', 0xBF58476D1CE4E5B9)} AS z FROM b), d AS (SELECT {keep}, {_shifted('z', 27)} AS z FROM c), e AS (SELECT {keep}, {_times('z', 0x94D049BB133111EB)} AS z FROM d),
f AS (SELECT {keep}, {_shifted('z', 31)} AS z FROM e)"""


_SPLITMIX = f"""WITH {splitmix_sql("events", "event_type", "user_id::HUGEINT * 1000003 + event_id")}
SELECT event_type, count(*) AS n, sum((z // 2048 < {1 << 51})::INT)::BIGINT AS n_kept FROM f GROUP BY 1"""

#: drawn(system_id, station_id, t, h_min): pairs of ``points`` that the sample holds.
DRAWN = f"""asked AS (SELECT system_id, station_id, t, h.h_min, h.i, md5(strftime(t + INTERVAL 9 HOUR, '%Y-%m-%d') || '|' || system_id || '|' || station_id) AS m, (hour(t + INTERVAL 9 HOUR) * 60 + minute(t + INTERVAL 9 HOUR)) // 360 AS g FROM points CROSS JOIN (SELECT unnest([360, 720, 1440]) AS h_min, unnest([0, 1, 2]) AS i) h),
{splitmix_sql("asked", "system_id, station_id, t, h_min", "('0x' || substr(m, 1, 8))::BIGINT::HUGEINT * 4294967296 + ('0x' || substr(m, 9, 8))::BIGINT + g * 3 + i")},
drawn AS (SELECT system_id, station_id, t, h_min FROM f WHERE z // 2048 < {1 << 51})"""

ORACLE = {
    "flagship_persistence_brier": f"""{_JUDGED}, kept AS (
  SELECT system_id, h_min, (seen.bikes >= 1)::INT AS pb, (seen.docks >= 1)::INT AS pd,
    (truth.bikes >= 1 AND truth.flags >= 0 AND (truth.flags & 2) > 0)::INT AS yb, (truth.docks >= 1 AND truth.flags >= 0 AND (truth.flags & 4) > 0)::INT AS yd
  FROM pairs WHERE target_reason IS NULL)
SELECT system_id, h_min, count(*) AS n, round(avg((pb - yb) * (pb - yb)), 9) AS brier_bike, round(avg(yb), 9) AS rate_bike, round(avg((pd - yd) * (pd - yd)), 9) AS brier_dock, round(avg(yd), 9) AS rate_dock
FROM kept GROUP BY ALL""",
    "grd_01_grid": f"WITH {T.OBS}, {GRID} SELECT system_id, t, count(*) AS n_points FROM points GROUP BY ALL",
    "grd_02_local_time": f"""WITH {T.OBS}, x AS (SELECT observed_at, observed_at + INTERVAL 9 HOUR AS l FROM obs)
SELECT l::DATE AS local_date, (hour(l) * 60 + minute(l))::INT AS minute_of_day, count(*) AS n, max(time_bucket(INTERVAL 5 MINUTE, observed_at)) AS last_step FROM x GROUP BY 1, 2""",
    "aso_01_feature_asof": f"WITH {T.OBS}, {GRID}, {FEATURE} SELECT system_id, station_id, t, seen.observed_at AS observed_at, seen.fetched_at AS fetched_at, seen.bikes AS bikes, seen.docks AS docks, seen.flags AS flags FROM feature",
    "aso_02_label_asof": f"""WITH {T.OBS}, {GRID}, x AS (SELECT p.system_id, p.station_id, p.t, max(struct_pack(observed_at := o.observed_at, fetched_at := o.fetched_at, bikes := o.bikes)) FILTER (o.observed_at IS NOT NULL) AS s
  FROM points p LEFT JOIN obs o ON o.system_id = p.system_id AND o.station_id = p.station_id AND o.observed_at <= p.t GROUP BY ALL)
SELECT system_id, station_id, t, s.observed_at AS observed_at, s.fetched_at AS fetched_at, s.bikes AS bikes FROM x""",
    "aso_03_gather": f"WITH {T.OBS}, {GRID}, {FEATURE} SELECT t, sum(coalesce(seen.bikes, -1))::BIGINT AS sum_bikes, sum(coalesce(seen.flags, -1))::BIGINT AS sum_flags FROM feature GROUP BY t",
    "aso_04_unreferenced": f"WITH {T.OBS}, {T.STATIONS} SELECT system_id, station_id, count(*) AS n_rows FROM obs WHERE (system_id, station_id) NOT IN (SELECT (system_id, station_id) FROM stations WHERE station_id::BIGINT % 5 <> 0) GROUP BY ALL",
    "aso_05_validity": f"""WITH {T.OBS}, {GRID}, {FEATURE} SELECT system_id, station_id, count(*) FILTER (seen IS NOT NULL AND seen.bikes <> -1 AND epoch_us(t) - epoch_us(seen.observed_at) <= 86400000000) AS n_valid, count(*) AS n_points FROM feature GROUP BY ALL""",
    "aso_06_aligned": f"WITH {T.OBS}, {T.STATIONS} SELECT s.system_id, s.station_id, count(observed_at) AS n_rows, max(observed_at) AS last_at FROM (SELECT DISTINCT system_id, station_id FROM stations) s LEFT JOIN obs o ON o.system_id = s.system_id AND o.station_id = s.station_id GROUP BY ALL",
    "lbl_01_labels": f"""WITH {T.OBS}, x AS (SELECT *, CASE WHEN bikes = -1 THEN -1 ELSE flags END AS f FROM obs)
SELECT system_id, station_id, observed_at, (bikes >= 1 AND f >= 0 AND (f & 2) > 0)::INT AS y_bike, (docks >= 1 AND f >= 0 AND (f & 4) > 0)::INT AS y_dock FROM x""",
    "lbl_02_collisions": f"""WITH {T.OBS}, {GRID}, {FEATURE}, {PAIRS}
SELECT system_id, h_min, count(*) FILTER (seen.observed_at = truth.observed_at AND seen.fetched_at = truth.fetched_at) AS n_collisions, count(*) AS n_pairs FROM pairs WHERE seen IS NOT NULL GROUP BY ALL""",
    "exc_01_base": f"""WITH {T.OBS}, {GRID}, {FEATURE} SELECT system_id, CASE WHEN station_id::BIGINT % 29 = 0 THEN 'phantom' ELSE coalesce({BASE_REASON}, 'kept') END AS reason, count(*) AS n_points FROM feature GROUP BY ALL""",
    "exc_02_target": f"{_JUDGED} SELECT system_id, h_min, coalesce(target_reason, 'kept') AS reason, count(*) AS n_pairs FROM pairs GROUP BY ALL",
    "exc_03_accounting": f"""{_JUDGED} SELECT system_id, base_reason AS reason, count(*) * 3 AS n_pairs FROM judged WHERE base_reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT system_id, coalesce(target_reason, 'kept') AS reason, count(*) AS n_pairs FROM pairs GROUP BY ALL""",
    "smp_01_sample": f"WITH {T.OBS}, {GRID}, {DRAWN} SELECT * FROM drawn",
    "smp_02_weights": f"WITH {T.OBS}, {GRID}, {DRAWN}, n AS (SELECT system_id, count(*) * 4.0::DOUBLE AS sum_weight FROM drawn GROUP BY 1) SELECT p.system_id, (count(*) * 3)::BIGINT AS n_pairs, coalesce(any_value(sum_weight), 0) AS sum_weight FROM points p LEFT JOIN n USING (system_id) GROUP BY 1",
    "smp_03_splitmix": _SPLITMIX,
    "spl_01_split": f"""WITH {T.OBS}, d AS (SELECT DISTINCT (observed_at + INTERVAL 9 HOUR)::DATE AS day FROM obs), r AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS n FROM d)
SELECT day, CASE WHEN n <= 5 THEN 'evaluate' WHEN n <= 6 THEN 'purge' ELSE 'fit' END AS part, n BETWEEN 7 AND 13 AS is_baseline FROM r""",
    "spl_02_window": f"""WITH {T.OBS}, d AS (SELECT DISTINCT (observed_at + INTERVAL 9 HOUR)::DATE AS day FROM obs)
SELECT w.day, d.day IS NOT NULL AS present FROM (SELECT unnest(generate_series(DATE '2024-01-28' - 34, DATE '2024-01-28', INTERVAL 1 DAY))::DATE AS day) w LEFT JOIN d ON d.day = w.day""",
}
