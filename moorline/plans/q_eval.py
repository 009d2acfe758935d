"""Queries of evaluation and exploration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moorline.config import SPARSE
from moorline.operators import asof, exclude, explore, labels, timegrid
from moorline.operators import evaluation as E
from moorline.operators import models as M
from moorline.plans import q_grid as G
from moorline.plans import q_models as MQ
from moorline.sources import tables as T

KEYS = E.KEYS


def P() -> Column:  # noqa: N802
    return F.col("p1000") / 1000


def Y() -> Column:  # noqa: N802
    return F.col("y")


def W() -> Column:  # noqa: N802
    return F.col("w")


def eva_01_scores(spark: SparkSession, d: str) -> DataFrame:
    return MQ.rows(spark, d).groupBy("system_id", "h_min").agg(F.round(E.brier(P(), Y(), W()), 9).alias("brier"), F.round(E.log_loss(P(), Y(), W()), 6).alias("log_loss"), F.round(E.positives(Y(), W()), 9).alias("positives"))


def eva_02_reliability(spark: SparkSession, d: str) -> DataFrame:
    r = E.reliability(MQ.rows(spark, d), ["system_id"])
    return r.withColumn("mean_p", F.round("mean_p", 9)).withColumn("observed", F.round("observed", 9))


def eva_03_reliability_quantile(spark: SparkSession, d: str) -> DataFrame:
    r = E.reliability_quantile(MQ.rows(spark, d), ["system_id"])
    return r.withColumn("mean_p", F.round("mean_p", 9)).withColumn("observed", F.round("observed", 9))


def eva_04_ece(spark: SparkSession, d: str) -> DataFrame:
    x = MQ.rows(spark, d)
    a = E.ece(E.reliability(x, ["system_id"]), ["system_id"]).select("system_id", F.round("ece", 9).alias("ece_width"))
    return a.join(E.ece(E.reliability_quantile(x, ["system_id"]), ["system_id"]).select("system_id", F.round("ece", 9).alias("ece_weight")), "system_id")


def eva_05_decision(spark: SparkSession, d: str) -> DataFrame:
    x = E.decision(MQ.rows(spark, d), ["system_id", "h_min"])
    return x.select("system_id", "h_min", *[F.round(c, 9).alias(c) for c in x.columns[2:]])


def eva_06_skill(spark: SparkSession, d: str) -> DataFrame:
    x = MQ.rows(spark, d).withColumn("b0", M.persistence(F.col("bikes")))
    s = x.groupBy("system_id", "h_min").agg(E.brier(P(), Y(), W()).alias("v"), E.brier(F.col("b0"), Y(), W()).alias("r"))
    return s.select("system_id", "h_min", F.round(E.skill(F.col("v"), F.col("r")), 9).alias("skill"))


def eva_07_slices(spark: SparkSession, d: str) -> DataFrame:
    x = MQ.rows(spark, d).withColumn("arrival_minute", (F.col("minute") + F.col("h_min")) % 1440)
    return E.slices(x, (5, 60))


def eva_08_harness(spark: SparkSession, d: str) -> DataFrame:
    """All baselines fitted on fit days, scored on the same rows, weighted and not."""
    x = MQ.with_baselines(spark, d).withColumn("p_b0", M.persistence(F.col("bikes"))).select("system_id", "h_min", "y", "w", "p_b0", "p_b1", "p_b2")
    long = E.unpivot_models(x, ["p_b0", "p_b1", "p_b2"], ["system_id", "h_min", "y", "w"])
    return long.groupBy("model", "system_id", "h_min").agg(F.count(F.lit(1)).alias("n"), F.round(E.brier(F.col("p"), Y(), W()), 6).alias("brier"), F.round(F.avg(F.pow(F.col("p") - Y(), 2)), 6).alias("brier_plain"))


def served_log(spark: SparkSession, d: str) -> DataFrame:
    """Forecast arrays of each entity and grid time, as they would have been logged."""
    p = G.grid_points(spark, d)
    n = F.col("station_id").cast("long") * 37 + F.hour("t") * 11 + F.dayofmonth("t") * 101
    arr = lambda m: F.array(*[((n * m + h) % 1001).cast("int") for h in SPARSE.horizons_min])
    return p.select(F.lit("v1").alias("model_version"), *KEYS, "t", F.array(*[F.lit(h) for h in SPARSE.horizons_min]).alias("horizons_min"), arr(1).alias("p_bike_x1000"), arr(3).alias("p_dock_x1000"))


def eva_09_served(spark: SparkSession, d: str) -> DataFrame:
    """Logged forecasts against later truth, both waterfalls, by version, system, target, horizon and bucket, with all buckets together."""
    _, pairs = G.judged_pairs(spark, d)
    kept = pairs.where(F.col("target_reason").isNull())
    served = E.to_served(served_log(spark, d)).hint("merge")  # entities that grew times and horizons, which no estimate of their size counts: joined by a sort, never broadcast
    x = kept.join(served, [*KEYS, "t", "h_min"])
    out = []
    for target, count in (("bike", "bikes"), ("dock", "docks")):
        y = getattr(labels, f"y_{target}")(F.col(f"truth.{count}"), F.col("truth.flags"))
        out.append(F.struct(F.lit(target).alias("target"), F.col(f"p_{target}").alias("p1000"), y.alias("y"), F.col(f"seen.{count}").alias("count")))
    x = x.select("model_version", "system_id", "h_min", F.explode(F.array(*out)).alias("z")).select("model_version", "system_id", "h_min", "z.*").withColumn("bucket", M.bucket(F.col("count")))
    sets = [[F.col(c) for c in ("model_version", "system_id", "target", "h_min", "bucket")], [F.col(c) for c in ("model_version", "system_id", "target", "h_min")]]
    keys = [F.col(c) for c in ("model_version", "system_id", "target", "h_min", "bucket")]
    return x.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("n"), F.round(E.brier_x1000(F.col("p1000"), Y()), 9).alias("brier"), F.round(E.brier_x1000(1000 * M.persistence(F.col("count")), Y()), 9).alias("brier_b0"))


def eva_10_log_selection(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the log written on a local day: pruned by path hour with one hour of margin, then by the write time."""
    e = T.read(spark, d, "events").select("event_id", F.col("ts").alias("base"), (F.col("ts") + F.make_dt_interval(mins=F.col("event_id") % 50)).alias("generated_at"))
    hour = F.date_trunc("hour", F.col("base"))
    first, last = F.to_timestamp_ntz(F.lit("2024-01-09 15:00:00")), F.to_timestamp_ntz(F.lit("2024-01-10 15:00:00"))
    near = e.where((hour >= first - F.expr("INTERVAL 1 HOUR")) & (hour < last))
    return near.where((F.col("generated_at") >= first) & (F.col("generated_at") < last)).select("event_id", "generated_at")


def eva_11_ablation(spark: SparkSession, d: str) -> DataFrame:
    b = E.bootstrap(E.port_sums(MQ.rows(spark, d), "p1000", "q1000"))
    return b.select("system_id", F.round("gain", 6).alias("gain"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "reps")


def eva_11_port_sums(spark: SparkSession, d: str) -> DataFrame:
    p = E.port_sums(MQ.rows(spark, d), "p1000", "q1000")
    return p.select("system_id", "station_id", F.round("full", 6).alias("full"), F.round("ablated", 6).alias("ablated"))


def eva_11_floor(spark: SparkSession, d: str) -> DataFrame:
    """The days from which a component helps: gain and its interval above 0, and three pairs not worse."""
    x = MQ.rows(spark, d).withColumn("days", F.col("p1000") % 7).withColumn("full", F.when(F.col("days") >= 3, F.col("y") * 400 + F.col("p1000") * 3 / 5).otherwise(F.col("p1000") * 1.0))
    return E.choose_floor(E.ablation_by_days(x, "days", "full", "q1000"), E.helped())


def eva_13_tree_budget(spark: SparkSession, d: str) -> DataFrame:
    """Fewest trees within a point of the largest candidate, by Brier improvement over persistence."""
    x = MQ.rows(spark, d).withColumn("trees", F.explode(F.array(*[F.lit(t) for t in (20, 70, 150, 300)])))
    p = (F.col("y") * F.least(F.col("trees"), F.lit(100)) + F.col("p1000") * 0.3) / 400
    s = x.withColumn("p", p).groupBy("trees").agg(E.brier(F.col("p"), Y(), W()).alias("v"), E.brier(M.persistence(F.col("bikes")), Y(), W()).alias("r"))
    return E.tree_budget(s.select("trees", E.skill(F.col("v"), F.col("r")).alias("improvement"))).select("trees", F.round("reference", 9).alias("reference"))


def eva_13_fitted_budget(spark: SparkSession, d: str) -> DataFrame:
    """The same over candidates that were fitted, on days that none of them saw."""
    r = MQ.rows(spark, d).where(F.col("day") >= MQ.SPLIT).agg(E.brier(M.persistence(F.col("bikes")), Y(), W()).alias("r"))
    s = MQ.mod_11_candidates(spark, d).join(F.broadcast(r))
    return E.tree_budget(s.select("trees", E.skill(F.col("brier"), F.col("r")).alias("improvement"))).select("trees", F.round("reference", 9).alias("reference"))


def eva_12_border(spark: SparkSession, d: str) -> DataFrame:
    table = E.border(MQ.table(spark, d)).select("system_id", "h_min", "bucket", "to_forest", "at_border")
    x = MQ.rows(spark, d).join(F.broadcast(table), ["system_id", "h_min", "bucket"])
    return E.gap_quantiles(x, ["to_forest", "at_border"])


def eva_13_ece_summary(spark: SparkSession, d: str) -> DataFrame:
    """The worst calibration error of each cut, and where it is."""
    x = MQ.rows(spark, d)
    h = E.ece(E.reliability(x, ["system_id", "h_min"]), ["system_id", "h_min"]).select("system_id", F.lit("h_min").alias("cut"), F.col("h_min").cast("string").alias("value"), "ece")
    k = E.ece(E.reliability(x, ["system_id", "dow_type"]), ["system_id", "dow_type"]).select("system_id", F.lit("dow_type").alias("cut"), F.col("dow_type").alias("value"), "ece")
    u = h.unionByName(k)
    return u.groupBy("system_id", "cut").agg(F.max_by("value", "ece").alias("worst"), F.round(F.max("ece"), 9).alias("ece"), (F.max("ece") < 0.03).alias("passes"))


def eva_13_top_importance(spark: SparkSession, d: str) -> DataFrame:
    imp = MQ.rows(spark, d).groupBy(F.concat(F.lit("f"), (F.col("p1000") % 50).cast("string")).alias("feature")).agg(F.sum("w").alias("importance"))
    return E.top_share(imp, 20).select(F.round("top_share", 9).alias("top_share"))


def eva_13_fitted_importance(spark: SparkSession, d: str) -> DataFrame:
    """How much of a fitted forest's importance its three most important inputs hold."""
    return E.top_share(MQ.mod_11_forest(spark, d), 3).select(F.round("top_share", 9).alias("top_share"))


def eva_14_arriving(spark: SparkSession, d: str) -> DataFrame:
    """Rows that arrive on a weekday: the kind of the target's day, not of the base's."""
    o = T.obs_long(spark, d).withColumn("h_min", F.explode(F.array(*[F.lit(h) for h in SPARSE.horizons_min])))
    target = timegrid.local_date(F.col("observed_at") + timegrid.minutes(F.col("h_min")), 9)
    return o.where(~F.dayofweek(target).isin(1, 7)).groupBy("system_id", "h_min").agg(F.count(F.lit(1)).alias("n"))


def HOUR() -> Column:  # noqa: N802
    return timegrid.local(F.col("observed_at"), 9)


def DAY() -> Column:  # noqa: N802
    return timegrid.local_date(F.col("observed_at"), 9)


def eda_01_availability(spark: SparkSession, d: str) -> DataFrame:
    return explore.availability(T.obs_long(spark, d))


def eda_02_missingness(spark: SparkSession, d: str) -> DataFrame:
    return explore.missingness(T.obs_long(spark, d), F.to_date("observed_at"))


def eda_03_hourly(spark: SparkSession, d: str) -> DataFrame:
    return explore.hourly(T.obs_long(spark, d), F.hour(HOUR()), DAY())


def eda_04_spread(spark: SparkSession, d: str) -> DataFrame:
    per, counts = explore.station_spread(T.obs_long(spark, d))
    return explore.nearest_rank(per, "zero_rate", (0.1, 0.5, 0.9), "zero").join(explore.nearest_rank(per, "moves", (0.5, 0.9), "moves")).join(counts)


def eda_05_flow_loss(spark: SparkSession, d: str) -> DataFrame:
    return explore.flow_loss(T.obs_long(spark, d), F.to_date("observed_at"))


def eda_06_rebalancing(spark: SparkSession, d: str) -> DataFrame:
    return explore.rebalancing(T.obs_long(spark, d), T.stations(spark, d), F.hour(HOUR()))


def eda_07_extremes(spark: SparkSession, d: str) -> DataFrame:
    return explore.extremes(T.obs_long(spark, d), 20, 14)


def eda_08_geo_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "customer").select("c_nationkey", "c_mktsegment", F.round("c_acctbal").cast("long").alias("v"))
    return explore.leave_one_out_mae(c, {"all": [], "nation": ["c_nationkey"], "segment": ["c_nationkey", "c_mktsegment"]}, "v")


def eda_09_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Counts, greatest gap, duplicates, failure rate, full-outer mismatch, and the spread of feed and poll gaps as one verdict table."""
    o, j = T.obs_long(spark, d), T.job_runs(spark, d)
    heads = o.select("system_id", F.date_trunc("hour", F.col("observed_at")).cast("timestamp_ntz").alias("h")).distinct()
    gap = (timegrid.micros(F.col("h")) - timegrid.micros(F.lag("h").over(Window.partitionBy("system_id").orderBy("h")))) / 60_000_000
    a = heads.withColumn("g", gap).agg(F.max("g").cast("double").alias("max_gap_min"), F.count(F.lit(1)).cast("double").alias("snapshots"))
    b = o.groupBy(*KEYS, "observed_at").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).cast("double").alias("duplicates"))
    c = j.agg(F.round(F.avg((F.col("status") == "failed").cast("double")), 6).alias("failure_rate"), F.percentile(F.col("run_id") % 90, 0.95).alias("p95_s"))
    # Raw objects against snapshots, of which one system lacks some and another has no snapshot.
    snaps = o.select("system_id", "observed_at").distinct()
    stored = snaps.where("system_id = 'a' or day(observed_at) <> 9").unionByName(snaps.limit(1).select(F.lit("c").alias("system_id"), "observed_at"))
    row = a.join(b).join(c).join(explore.count_mismatch(snaps, stored, ["system_id"]))
    row = row.join(explore.gap_spread(o, ["system_id"], "observed_at", "feed")).join(explore.gap_spread(j, ["system_id"], "started_at", "poll"))
    row = row.select(*[F.round(n, 6).alias(n) for n in row.columns])
    return explore.verdicts(row, {"max_gap_min": 600.0, "duplicates": 0.0, "failure_rate": 0.1, "p95_s": 60.0, "mismatch": 0.0, "feed_max_s": 1800.0, "poll_max_s": 180.0})


QUERIES = {n: f for n, f in list(globals().items()) if n[:4] in ("eva_", "eda_")}

REL = "rel AS (SELECT {by}, least(p1000 * 20 // 1000, 19)::INT AS bin, count(*) AS n, sum(w)::BIGINT AS sum_w, sum(w * p1000) / sum(w)::DOUBLE / 1000 AS mean_p, sum(w * y) / sum(w)::DOUBLE AS observed FROM rows GROUP BY ALL)"
QUANT = """v AS (SELECT system_id, p1000, sum(w) AS w, sum(w * y) AS wy, count(*) AS n FROM rows GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY system_id ORDER BY p1000) AS c, sum(w) OVER (PARTITION BY system_id) AS t FROM v),
edge AS (SELECT c.system_id, k, min(p1000) AS e FROM c, (SELECT unnest(range(1, 15)) AS k) WHERE c.c * 15 >= k * t GROUP BY ALL),
vb AS (SELECT c.*, (SELECT count(*) FROM edge WHERE edge.system_id = c.system_id AND e < c.p1000) AS bin FROM c),
quant AS (SELECT system_id, bin::INT AS bin, sum(n)::BIGINT AS n, sum(w)::BIGINT AS sum_w, sum(w * p1000) / sum(w)::DOUBLE / 1000 AS mean_p, sum(wy) / sum(w)::DOUBLE AS observed FROM vb GROUP BY ALL)"""
MOVES = f"{T.OBS}, seen AS (SELECT *, bikes - lag(bikes) OVER (PARTITION BY system_id, station_id ORDER BY observed_at, fetched_at) AS d FROM obs WHERE bikes <> -1 AND docks <> -1)"
_BR = "sum(w * pow(p1000 / 1000.0::DOUBLE - y, 2)) / sum(w)"
_SL = f"count(*) AS n, round({_BR}, 9) AS brier, round(sum(w * y) / sum(w)::DOUBLE, 9) AS positives FROM sl"

_SHARES = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]
DRAWN = f"""u AS (SELECT *, (('0x' || substr(md5(system_id || '|' || station_id || '|' || rep::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS v FROM ports, (SELECT unnest(range(1, {E.REPS + 1})) AS rep)),
drawn AS (SELECT *, CASE {' '.join(f"WHEN v < {x!r}::DOUBLE THEN {k}" for k, x in enumerate(_SHARES))} ELSE 9 END AS k FROM u)"""

ORACLE = {
    "eva_01_scores": f"""WITH {MQ.ROWS} SELECT system_id, h_min, round({_BR}, 9) AS brier, round(-sum(w * (y * ln(least(greatest(p1000 / 1000.0::DOUBLE, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p1000 / 1000.0::DOUBLE, 1e-15), 1 - 1e-15)))) / sum(w), 6) AS log_loss,
  round(sum(w * y) / sum(w)::DOUBLE, 9) AS positives FROM rows GROUP BY ALL""",
    "eva_02_reliability": f"WITH {MQ.ROWS}, {REL.format(by='system_id')} SELECT system_id, bin, n, sum_w, round(mean_p, 9) AS mean_p, round(observed, 9) AS observed FROM rel",
    "eva_03_reliability_quantile": f"WITH {MQ.ROWS}, {QUANT} SELECT system_id, bin, n, sum_w, round(mean_p, 9) AS mean_p, round(observed, 9) AS observed FROM quant",
    "eva_04_ece": f"""WITH {MQ.ROWS}, {REL.format(by='system_id')}, {QUANT}, a AS (SELECT system_id, round(sum(sum_w * abs(observed - mean_p)) / sum(sum_w), 9) AS ece_width FROM rel GROUP BY 1), b AS (SELECT system_id, round(sum(sum_w * abs(observed - mean_p)) / sum(sum_w), 9) AS ece_weight FROM quant GROUP BY 1) SELECT * FROM a JOIN b USING (system_id)""",
    "eva_05_decision": f"WITH {MQ.ROWS} SELECT system_id, h_min, "
    + ", ".join(f"round(coalesce(sum(w) FILTER ({c}), 0) / sum(w)::DOUBLE, 9) AS share_{n}, round(sum(w * y) FILTER ({c}) / sum(w) FILTER ({c})::DOUBLE, 9) AS rate_{n}" for n, c in (("high", "p1000 >= 900"), ("sure", "p1000 >= 850"), ("likely", "p1000 < 850 AND p1000 >= 600"), ("unsure", "p1000 < 600")))
    + " FROM rows GROUP BY ALL",
    "eva_06_skill": f"WITH {MQ.ROWS} SELECT system_id, h_min, round(1 - ({_BR}) / (sum(w * pow((bikes >= 1)::INT - y, 2)) / sum(w)), 9) AS skill FROM rows GROUP BY ALL",
    "eva_07_slices": f"""WITH {MQ.ROWS}, sl AS (SELECT *, CASE WHEN hr <= 5 THEN 'night' WHEN hr <= 9 THEN 'morning' WHEN hr <= 15 THEN 'day' WHEN hr <= 19 THEN 'evening' ELSE 'late' END AS band FROM (SELECT *, ((minute + h_min) % 1440) // 60 AS hr FROM rows))
SELECT 'overall' AS slice, NULL AS h_min, NULL AS bucket, NULL AS dow_type, NULL AS band, {_SL}
UNION ALL SELECT 'horizon', h_min, NULL, NULL, NULL, {_SL} GROUP BY h_min UNION ALL SELECT 'bucket', h_min, bucket, NULL, NULL, {_SL} WHERE h_min IN (5, 60) GROUP BY h_min, bucket
UNION ALL SELECT 'dow_type', NULL, NULL, dow_type, NULL, {_SL} GROUP BY dow_type UNION ALL SELECT 'band', NULL, NULL, NULL, band, {_SL} GROUP BY band""",
    "eva_08_harness": f"""WITH {MQ.ROWS}, {MQ.B1}, {MQ.CELLS}, x AS (SELECT r.system_id, r.h_min, r.y, r.w, (bikes >= 1)::INT::DOUBLE AS p_b0, c1.r AS p_b1, coalesce(c.rate, c1.r) AS p_b2 FROM rows r LEFT JOIN c1 ON c1.system_id = r.system_id AND c1.h_min = r.h_min AND c1.bucket = r.bucket
  LEFT JOIN cells c ON c.system_id = r.system_id AND c.station_id = r.station_id AND c.dow_type = r.dow_type AND usable WHERE day >= DATE '{MQ.SPLIT}'), u AS (UNPIVOT x ON p_b0, p_b1, p_b2 INTO NAME model VALUE p)
SELECT model, system_id, h_min, count(*) AS n, round(sum(w * pow(p - y, 2)) / sum(w), 6) AS brier, round(avg(pow(p - y, 2)), 6) AS brier_plain FROM u GROUP BY ALL""",
    "eva_09_served": f"""{G._JUDGED}, k AS (SELECT *, station_id::BIGINT * 37 + hour(t) * 11 + day(t) * 101 AS n FROM pairs WHERE target_reason IS NULL),
z AS (SELECT system_id, h_min, 'bike' AS target, (n + h_min) % 1001 AS p, (truth.bikes >= 1 AND truth.flags >= 0 AND (truth.flags & 2) > 0)::INT AS y, seen.bikes AS bikes FROM k UNION ALL SELECT system_id, h_min, 'dock', (n * 3 + h_min) % 1001, (truth.docks >= 1 AND truth.flags >= 0 AND (truth.flags & 4) > 0)::INT, seen.docks FROM k),
zz AS (SELECT *, {MQ.B} AS bucket FROM z)
SELECT 'v1' AS model_version, system_id, target, h_min, bucket, count(*) AS n, round(avg(pow(p / 1000.0::DOUBLE - y, 2)), 9) AS brier, round(avg(pow((bikes >= 1)::INT - y, 2)), 9) AS brier_b0 FROM zz GROUP BY GROUPING SETS ((system_id, target, h_min, bucket), (system_id, target, h_min))""",
    "eva_10_log_selection": """SELECT event_id, ts + to_minutes(event_id % 50) AS generated_at FROM events WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-09 14:00:00' AND date_trunc('hour', ts) < TIMESTAMP '2024-01-10 15:00:00'
  AND ts + to_minutes(event_id % 50) >= TIMESTAMP '2024-01-09 15:00:00' AND ts + to_minutes(event_id % 50) < TIMESTAMP '2024-01-10 15:00:00'""",
    "eva_11_port_sums": f"WITH {MQ.ROWS} SELECT system_id, station_id, round(sum(w * pow(p1000 / 1000.0::DOUBLE - y, 2)), 6) AS full, round(sum(w * pow(q1000 / 1000.0::DOUBLE - y, 2)), 6) AS ablated FROM rows GROUP BY ALL",
    "eva_11_ablation": f"""WITH {MQ.ROWS}, ports AS (SELECT system_id, station_id, sum(w * pow(p1000 / 1000.0::DOUBLE - y, 2)) AS f, sum(w * pow(q1000 / 1000.0::DOUBLE - y, 2)) AS a FROM rows GROUP BY ALL), {DRAWN},
reps AS (SELECT system_id, rep, sum(k * (a - f)) / nullif(sum(k * f), 0) AS g FROM drawn GROUP BY ALL), sp AS (SELECT system_id, quantile_cont(g, 0.025) AS low, quantile_cont(g, 0.975) AS high, count(*) AS reps FROM reps GROUP BY ALL)
SELECT p.system_id, round(sum(a - f) / sum(f), 6) AS gain, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, any_value(reps) AS reps FROM ports p JOIN sp USING (system_id) GROUP BY ALL""",
    "eva_11_floor": f"""WITH {MQ.ROWS}, x AS (SELECT *, p1000 % 7 AS d, CASE WHEN p1000 % 7 >= 3 THEN y * 400 + p1000 * 3 / 5.0::DOUBLE ELSE p1000 END AS f FROM rows),
prs AS (SELECT d, system_id, h_min, sum(w * pow(f / 1000 - y, 2)) AS f, sum(w * pow(q1000 / 1000.0::DOUBLE - y, 2)) AS a FROM x GROUP BY ALL), cnt AS (SELECT d, count(*) FILTER (f <= a) AS ok FROM prs GROUP BY ALL),
ports AS (SELECT d, system_id, station_id, sum(w * pow(f / 1000 - y, 2)) AS f, sum(w * pow(q1000 / 1000.0::DOUBLE - y, 2)) AS a FROM x GROUP BY ALL), {DRAWN},
reps AS (SELECT d, rep, sum(k * (a - f)) / nullif(sum(k * f), 0) AS g FROM drawn GROUP BY ALL), sp AS (SELECT d, quantile_cont(g, 0.025) AS low FROM reps GROUP BY ALL), tot AS (SELECT d, sum(a - f) / sum(f) AS gain FROM ports GROUP BY ALL),
m AS (SELECT d AS k, gain > 0 AND low > 0 AND ok >= 3 AS ok FROM tot JOIN sp USING (d) JOIN cnt USING (d))
SELECT min(k) FILTER (k > coalesce((SELECT max(k) FROM m WHERE NOT ok), -1)) AS floor FROM m""",
    "eva_13_tree_budget": f"""WITH {MQ.ROWS}, x AS (SELECT *, unnest([20, 70, 150, 300]) AS trees FROM rows), s AS (SELECT trees, 1 - sum(w * pow((y * least(trees, 100) + p1000 * 0.3::DOUBLE) / 400 - y, 2)) / sum(w * pow((bikes >= 1)::INT - y, 2)) AS i FROM x GROUP BY 1), t AS (SELECT arg_max(i, trees) AS r FROM s)
SELECT min(trees) AS trees, round(max(r), 9) AS reference FROM s, t WHERE i >= r - 0.01""",
    "eva_12_border": f"""WITH {MQ.GATE}, b AS (SELECT *, to_forest AND (NOT coalesce(lag(to_forest) OVER h, true) OR NOT coalesce(lead(to_forest) OVER h, true) OR NOT coalesce(lag(to_forest) OVER k, true) OR NOT coalesce(lead(to_forest) OVER k, true)) AS at_border FROM tab
  WINDOW h AS (PARTITION BY system_id, bucket ORDER BY h_min), k AS (PARTITION BY system_id, h_min ORDER BY bucket)), g AS (SELECT to_forest, at_border, abs(p1000 - q1000) AS x FROM rows r JOIN b USING (system_id, h_min, bucket))
SELECT to_forest, at_border, count(*) AS n, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90, max(x) AS largest FROM g GROUP BY ALL""",
    "eva_13_ece_summary": f"""WITH {MQ.ROWS}, {REL.format(by='system_id, h_min').replace('rel AS', 'r1 AS')}, {REL.format(by='system_id, dow_type').replace('rel AS', 'r2 AS')},
u AS (SELECT system_id, 'h_min' AS cut, h_min::VARCHAR AS value, sum(sum_w * abs(observed - mean_p)) / sum(sum_w) AS ece FROM r1 GROUP BY ALL UNION ALL SELECT system_id, 'dow_type', dow_type, sum(sum_w * abs(observed - mean_p)) / sum(sum_w) FROM r2 GROUP BY ALL)
SELECT system_id, cut, arg_max(value, ece) AS worst, round(max(ece), 9) AS ece, max(ece) < 0.03 AS passes FROM u GROUP BY ALL""",
    "eva_13_top_importance": f"WITH {MQ.ROWS}, i AS (SELECT p1000 % 50 AS f, sum(w) AS v FROM rows GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, 'f' || f::VARCHAR) AS n FROM i) SELECT round(sum(v) FILTER (n <= 20) / sum(v)::DOUBLE, 9) AS top_share FROM r",
    "eva_14_arriving": f"WITH {T.OBS}, x AS (SELECT system_id, observed_at, unnest([360, 720, 1440]) AS h_min FROM obs) SELECT system_id, h_min, count(*) AS n FROM x WHERE dayofweek(observed_at + to_minutes(h_min) + INTERVAL 9 HOUR) NOT IN (0, 6) GROUP BY ALL",
    "eda_01_availability": f"""WITH {T.OBS} SELECT system_id, count(*) AS n, round(avg((bikes = 0)::INT) * 100, 6) AS pct_no_bikes, round(avg((docks = 0)::INT) * 100, 6) AS pct_no_docks, round(avg((bikes = 0 AND docks = 0)::INT) * 100, 6) AS pct_neither, round(avg(bikes), 6) AS mean_bikes, round(avg(docks), 6) AS mean_docks,
  max(bikes) AS max_bikes, max(docks) AS max_docks, round(avg((flags = 1)::INT) * 100, 6) AS pct_installed_only FROM obs WHERE bikes <> -1 AND docks <> -1 GROUP BY 1""",
    "eda_02_missingness": f"""WITH {T.OBS}, p AS (SELECT system_id, observed_at::DATE AS s, count(*) AS n, count(*) FILTER (bikes = -1) AS m FROM obs GROUP BY ALL) SELECT p.system_id, count(*) AS n_snapshots, count(DISTINCT n) AS n_lengths, round(sum(m) / sum(n)::DOUBLE * 100, 6) AS pct_missing, any_value(k) AS n_stations
FROM p JOIN (SELECT system_id, count(DISTINCT station_id) AS k FROM obs GROUP BY 1) q USING (system_id) GROUP BY 1""",
    "eda_03_hourly": f"WITH {MOVES} SELECT system_id, hour(observed_at + INTERVAL 9 HOUR)::INT AS hour, count(*) AS n, count(DISTINCT (observed_at + INTERVAL 9 HOUR)::DATE) AS n_days, round(avg((bikes = 0)::INT) * 100, 6) AS pct_zero, round(avg(bikes), 6) AS mean_bikes, round(avg(abs(d)), 6) AS mean_move FROM seen GROUP BY ALL",
    "eda_04_spread": f"""WITH {MOVES}, p AS (SELECT round(avg((bikes = 0)::INT), 6) AS z, coalesce(sum(abs(d)), 0)::BIGINT AS m FROM seen GROUP BY system_id, station_id),
r AS (SELECT *, row_number() OVER (ORDER BY z) - 1 AS rz, row_number() OVER (ORDER BY m) - 1 AS rm, count(*) OVER () AS n FROM p)
SELECT max(z) FILTER (rz = round_even((n - 1) * 0.1, 0)) AS zero_p10, max(z) FILTER (rz = round_even((n - 1) * 0.5, 0)) AS zero_p50, max(z) FILTER (rz = round_even((n - 1) * 0.9, 0)) AS zero_p90, max(m) FILTER (rm = round_even((n - 1) * 0.5, 0)) AS moves_p50, max(m) FILTER (rm = round_even((n - 1) * 0.9, 0)) AS moves_p90,
  count(*) FILTER (z = 1) AS always_empty, count(*) FILTER (z = 0) AS never_empty, count(*) FILTER (m = 0) AS never_changed, max(m) AS max_moves FROM r""",
    "eda_05_flow_loss": f"""WITH {MOVES}, a AS (SELECT system_id, sum(abs(d))::BIGINT AS native FROM seen GROUP BY 1), l AS (SELECT system_id, station_id, observed_at::DATE AS g, arg_max(bikes, observed_at) AS b FROM seen GROUP BY ALL), m AS (SELECT system_id, b - lag(b) OVER (PARTITION BY system_id, station_id ORDER BY g) AS d FROM l),
c AS (SELECT system_id, sum(abs(d))::BIGINT AS gridded FROM m GROUP BY 1) SELECT system_id, native, gridded, round((1 - gridded / native::DOUBLE) * 100, 6) AS pct_lost FROM a JOIN c USING (system_id)""",
    "eda_06_rebalancing": f"""WITH {MOVES}, {T.STATIONS}, x AS (SELECT s.*, hour(observed_at + INTERVAL 9 HOUR)::INT AS hour, abs(d) >= greatest(4.0, coalesce(c.capacity * 0.5, 4.0)) AS big FROM seen s LEFT JOIN stations c ON c.system_id = s.system_id AND c.station_id = s.station_id)
SELECT system_id, hour, count(*) FILTER (big) AS n_events, count(DISTINCT station_id) FILTER (big) AS n_stations, round(count(*) FILTER (big) / count(*)::DOUBLE, 6) AS rate, max(abs(d)) FILTER (big) AS largest FROM x GROUP BY ALL""",
    "eda_07_extremes": f"WITH {T.OBS}, p AS (SELECT system_id, station_id, max(docks) AS max_docks, max(bikes + docks) AS capacity_seen FROM obs GROUP BY ALL) SELECT *, max_docks >= 14 AS is_implausible FROM p ORDER BY max_docks DESC, system_id, station_id LIMIT 20",
    "eda_08_geo_fallback": """WITH c AS (SELECT c_nationkey AS n, c_mktsegment AS s, round(c_acctbal)::BIGINT AS v FROM customer), x AS (SELECT v, sum(v) OVER () AS sa, count(*) OVER () AS ca, sum(v) OVER (PARTITION BY n) AS sn, count(*) OVER (PARTITION BY n) AS cn, sum(v) OVER (PARTITION BY n, s) AS ss, count(*) OVER (PARTITION BY n, s) AS cs FROM c),
y AS (SELECT v, (sa - v) / (ca - 1)::DOUBLE AS a, CASE WHEN cn > 1 THEN (sn - v) / (cn - 1)::DOUBLE ELSE (sa - v) / (ca - 1)::DOUBLE END AS b, CASE WHEN cs > 1 THEN (ss - v) / (cs - 1)::DOUBLE ELSE (sa - v) / (ca - 1)::DOUBLE END AS c FROM x)
SELECT round(avg(abs(a - v)), 6) AS mae_all, round(avg(abs(b - v)), 6) AS mae_nation, round(avg(abs(c - v)), 6) AS mae_segment FROM y""",
    "eda_09_acceptance": f"""WITH {T.OBS}, {T.JOBS}, snap AS (SELECT DISTINCT system_id, observed_at FROM obs), stored AS (SELECT system_id FROM snap WHERE system_id = 'a' OR day(observed_at) <> 9 UNION ALL SELECT 'c'),
fg AS (SELECT (epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (PARTITION BY system_id ORDER BY observed_at))) / 1000000.0::DOUBLE AS g FROM snap),
pg AS (SELECT (epoch_us(started_at) - epoch_us(lag(started_at) OVER (PARTITION BY system_id ORDER BY started_at))) / 1000000.0::DOUBLE AS g FROM (SELECT DISTINCT system_id, started_at FROM jobs)), h AS (SELECT DISTINCT system_id, date_trunc('hour', observed_at) AS h FROM obs), g AS (SELECT (epoch(h) - epoch(lag(h) OVER (PARTITION BY system_id ORDER BY h))) / 60 AS g FROM h),
r AS (SELECT 'max_gap_min' AS "check", max(g)::DOUBLE AS value FROM g UNION ALL SELECT 'snapshots', count(*)::DOUBLE FROM g UNION ALL SELECT 'duplicates', count(*) FILTER (n > 1)::DOUBLE FROM (SELECT count(*) AS n FROM obs GROUP BY system_id, station_id, observed_at)
  UNION ALL SELECT 'failure_rate', round(avg((status = 'failed')::INT), 6) FROM jobs UNION ALL SELECT 'p95_s', quantile_cont(run_id % 90, 0.95) FROM jobs
  UNION ALL SELECT 'mismatch', count(*) FILTER (a.n IS DISTINCT FROM b.n)::DOUBLE FROM (SELECT system_id, count(*) AS n FROM snap GROUP BY 1) a FULL JOIN (SELECT system_id, count(*) AS n FROM stored GROUP BY 1) b USING (system_id)
  UNION ALL SELECT 'feed_median_s', quantile_cont(g, 0.5) FROM fg UNION ALL SELECT 'feed_p95_s', quantile_cont(g, 0.95) FROM fg UNION ALL SELECT 'feed_max_s', max(g) FROM fg
  UNION ALL SELECT 'poll_median_s', quantile_cont(g, 0.5) FROM pg UNION ALL SELECT 'poll_p95_s', quantile_cont(g, 0.95) FROM pg UNION ALL SELECT 'poll_max_s', max(g) FROM pg)
SELECT "check", round(value, 6) AS value, CASE WHEN coalesce(round(value, 6) <= CASE "check" WHEN 'max_gap_min' THEN 600.0 WHEN 'duplicates' THEN 0.0 WHEN 'failure_rate' THEN 0.1 WHEN 'p95_s' THEN 60.0 WHEN 'mismatch' THEN 0.0 WHEN 'feed_max_s' THEN 1800.0 WHEN 'poll_max_s' THEN 180.0 END, true) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r""",
}
