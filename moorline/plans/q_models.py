"""Queries of baseline tables, trends, calibration, gates and forecast assembly."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.operators import models as M
from moorline.operators import routing, timegrid, trees
from moorline.plans import q_features as Q
from moorline.plans.scratch import written
from moorline.sources import tables as T

KEYS = M.KEYS
FLOORS = {"weekday": 3, "sat": 4, "sun_holiday": 4}
SPLIT = "1998-01-01"
CLIMATE = ["system_id", "station_id", "dow_type"]


def rows(spark: SparkSession, d: str) -> DataFrame:
    return T.scores(spark, d).withColumn("bucket", M.bucket(F.col("bikes")))


def fit_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).where(F.col("day") < SPLIT)


def with_baselines(spark: SparkSession, d: str) -> DataFrame:
    fit = fit_rows(spark, d)
    out = M.conditional_predict(rows(spark, d).where(F.col("day") >= SPLIT), M.conditional_fit(fit))
    return M.climatology_predict(out, M.climatology_fit(fit, CLIMATE, 30, FLOORS), CLIMATE, "p_b1")


def gate_rows(spark: SparkSession, d: str) -> DataFrame:
    x = rows(spark, d).withColumn("target", F.lit("bike"))
    b3 = F.when(F.col("h_min") == 60, F.col("y") * 0.6 + F.col("q1000") * 0.0004).otherwise(F.col("y") * 0.5 + F.col("p1000") * 0.0005)
    forest = F.when(F.col("bucket") == 3, F.col("q1000") / 1000).otherwise(F.col("y") * 0.7 + F.col("q1000") * 0.0003)
    return x.withColumn("p_b0", F.when(F.col("h_min") == 5, F.col("y").cast("double")).otherwise(M.persistence(F.col("bikes")))).withColumn("p_b3", b3).withColumn("p_forest", forest)


def mod_00_bucket(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("bikes").alias("low"), F.max("bikes").alias("high"))


def mod_01_persistence(spark: SparkSession, d: str) -> DataFrame:
    x = rows(spark, d).withColumn("p", M.persistence(F.col("bikes")))
    return x.groupBy("h_min").agg(F.round(F.sum(F.col("w") * F.pow(F.col("p") - F.col("y"), 2)) / F.sum("w"), 9).alias("brier"))


def mod_02_conditional(spark: SparkSession, d: str) -> DataFrame:
    fit = fit_rows(spark, d).where("not (h_min = 60 and bucket = 5)")
    x = M.conditional_predict(rows(spark, d).where(F.col("day") >= SPLIT), M.conditional_fit(fit))
    return x.groupBy("system_id", "h_min", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("p_b1"), 9).alias("p_b1"))


def mod_03_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    x = M.conditional_leave_one_out(fit_rows(spark, d))
    return x.groupBy("system_id", "h_min", "bucket").agg(F.round(F.avg("p_loo"), 6).alias("mean_p"), F.round(F.max("p_loo"), 9).alias("max_p"))


def mod_04_climatology(spark: SparkSession, d: str) -> DataFrame:
    x = with_baselines(spark, d)
    return x.groupBy("system_id", "dow_type").agg(F.count_if("informed").alias("n_informed"), F.count(F.lit(1)).alias("n"), F.round(F.avg("p_b2"), 6).alias("mean_p"))


def mod_05_leave_day_out(spark: SparkSession, d: str) -> DataFrame:
    fit = fit_rows(spark, d)
    x = M.conditional_predict(fit, M.conditional_fit(fit))
    x = M.climatology_leave_day_out(x, CLIMATE, 30, FLOORS, "p_b1")
    return x.groupBy("system_id", "dow_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_b2_out"), 6).alias("mean_p"), F.round(F.min("p_b2_out"), 6).alias("min_p"))


def mod_06_blend(spark: SparkSession, d: str) -> DataFrame:
    x = with_baselines(spark, d)
    half = F.pmod(F.xxhash64("station_id", "day"), F.lit(2)) == 0
    scored = M.blend_predict(x.where(~half), M.blend_fit(written(x.where(half), "blend")))
    return scored.groupBy("system_id", "h_min").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("w") * F.pow(F.col("p_b3") - F.col("y"), 2)) / F.sum("w"), 6).alias("brier_b3"))


def trend(spark: SparkSession, d: str, last: str = "2024-12-31") -> DataFrame:
    return M.hourly_trend(Q.profile(spark, d, last), 2, {"weekday": 3, "sat": 2, "sun_holiday": 2})


def mod_07_trend(spark: SparkSession, d: str) -> DataFrame:
    return trend(spark, d).select(*KEYS, "dow_type", "hour", "n", "n_ok", "n_days", F.round("rate", 9).alias("rate"), F.round("port_rate", 9).alias("port_rate"))


def mod_08_lagged_pairs(spark: SparkSession, d: str) -> DataFrame:
    days = T.obs_long(spark, d).select(timegrid.local_date(F.col("observed_at"), 9).alias("day")).distinct()
    pairs = M.lagged_pairs(days.where(F.dayofmonth("day") >= 15), 6, 0, 2)
    return pairs.join(days.select(F.col("day").alias("edition")), "edition", "left_semi")


PUBLISHED = "2024-01-29"
TREND_FLOORS = {"weekday": 3, "sat": 2, "sun_holiday": 2}


def window_pairs(spark: SparkSession, first: int, last: int, lag: int) -> DataFrame:
    """(day, edition) of the arrival days from ``first`` to ``last`` days before the published one, with the edition ``lag`` days before each."""
    published = spark.sql(f"SELECT DATE '{PUBLISHED}' AS day")
    return M.lagged_pairs(published, first, last, lag).select("day", "edition")


def trend_windows(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Rows that the served calibration is fitted on, those that the gate's is fitted on (7 days before), and those it is judged on (the newest days, by the edition of 7 days before). Written: the fits pass over them many times."""
    daily = written(Q.dailies(spark, d), "dailies")
    gate_test = spark.sql(f"SELECT explode(sequence(DATE '{PUBLISHED}' - 6, DATE '{PUBLISHED}')) AS day, DATE '{PUBLISHED}' - 7 AS edition")
    pairs = {"serve": window_pairs(spark, 6, 0, 2), "gate_fit": window_pairs(spark, 13, 7, 2), "gate_test": gate_test}
    return {n: written(M.trend_rows(daily, p, 28, 2, TREND_FLOORS), n) for n, p in pairs.items()}


TREND_GROUP = ["system_id", "target"]


def each_group(fit: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with p_trend, calibrated for each system and target on ``fit``: all groups in the same few passes."""
    return M.calibrated(rows, M.calibrate(fit, TREND_GROUP))


def mod_09_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated trends of the served window against what came."""
    x = trend_windows(spark, d)["serve"]
    x = each_group(x, x)
    return x.groupBy("system_id", "target").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("w") * F.col("p_trend")) / F.sum("w"), 6).alias("mean_p"), F.round(F.sum(F.col("w") * F.col("y")) / F.sum("w"), 6).alias("observed"))


def judged_trend(windows: dict[str, DataFrame]) -> DataFrame:
    return M.trend_gate(M.binomial(each_group(windows["gate_fit"], windows["gate_test"])), "p_trend", "port_rate")


def mod_10_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate of each system and target: a calibration fitted a week before, judged on days it has not seen."""
    g = judged_trend(trend_windows(spark, d))
    return g.select("system_id", "target", F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"), F.round("brier_port", 6).alias("brier_port"), "passes")


def mod_10_trend_publish(spark: SparkSession, d: str) -> DataFrame:
    """72 values for each entity and target from the newest edition; null where the group fails its gate."""
    windows = trend_windows(spark, d)
    newest = trend(spark, d, PUBLISHED).where("rate is not null")
    rows = newest.select(*KEYS, "dow_type", "hour", F.explode(F.array(F.struct(F.lit("bike").alias("target"), "rate", "port_rate"), F.struct(F.lit("dock").alias("target"), F.col("rate_dock").alias("rate"), F.col("port_rate_dock").alias("port_rate")))).alias("z")).select(*KEYS, "dow_type", "hour", "z.*")
    x = each_group(windows["serve"], rows)
    x = x.join(F.broadcast(judged_trend(windows).select("system_id", "target", "passes")), ["system_id", "target"]).withColumn("p", F.when(F.col("passes"), F.col("p_trend")))
    return M.trend_arrays(x.where("target = 'bike'"), "p").withColumn("target", F.lit("bike")).unionByName(M.trend_arrays(x.where("target = 'dock'"), "p").withColumn("target", F.lit("dock")))


def forest_rows(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("dow_type") == "sat", 0).when(F.col("dow_type") == "sun_holiday", 1).otherwise(2)
    return rows(spark, d).select("system_id", "h_min", "bucket", "bikes", "minute", "p1000", kind.alias("kind"), "y", "w", "day")


COLUMNS = ["bikes", "minute", "h_min", "p1000", "kind", "bucket"]
CODES = {"kind": 3, "bucket": 6}


def fitted_forest(spark: SparkSession, d: str):  # noqa: ANN201
    """The forest of the fit days with the operator's own trees, rate and depth."""
    x = forest_rows(spark, d)
    return x, M.forest_fit(fit_cells(x), COLUMNS, "y", "w", categorical=CODES)


def fit_cells(x: DataFrame) -> DataFrame:
    """The fit days' rows as cells, written once: boosting passes over them for every tree, and their number does not grow with the rows."""
    return written(M.forest_cells(x.where(F.col("day") < SPLIT), COLUMNS, "y", "w", CODES), "cells")


def mod_11_forest(spark: SparkSession, d: str) -> DataFrame:
    """Feature importances of a forest fitted on the fit days."""
    x, model = fitted_forest(spark, d)
    names = [n[1:] for n in M.forest_inputs(COLUMNS, CODES)]
    v = [float(i) for i in model.stages[-1].featureImportances.toArray()]
    total = x.agg(F.count(F.lit(1)).alias("n_rows"))
    return total.select("n_rows", F.explode(F.arrays_zip(F.lit(names).alias("feature"), F.lit(v).alias("importance"))).alias("z")).select("n_rows", "z.*")


def mod_11_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Brier scores of several (trees, rate) on days that none of them was fitted on."""
    x = written(forest_rows(spark, d), "forest")
    c = M.forest_candidates(fit_cells(x), x.where(F.col("day") >= SPLIT), COLUMNS, [(5, 0.15), (10, 0.15), (20, 0.15)], categorical=CODES)
    return c.withColumn("brier", F.round("brier", 6))


def mod_12_forest_score(spark: SparkSession, d: str) -> DataFrame:
    x, model = fitted_forest(spark, d)
    s = M.forest_score(x.where(F.col("day") >= SPLIT), model, COLUMNS, categorical=CODES)
    return s.groupBy("system_id", "h_min").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_forest"), 6).alias("mean_p"))


BOUNDED = trees.Params(trees=3, leaves=31, least_leaf=50, rising=("bikes",))


def bounded_forest(spark: SparkSession, d: str) -> tuple[DataFrame, trees.Forest]:
    """Forest rows, and a forest of bounded leaves that never falls along the own count, fitted on the fit days."""
    x = written(forest_rows(spark, d), "forest")
    return x, trees.fit(x.where(F.col("day") < SPLIT), COLUMNS, "y", "w", written, BOUNDED, CODES)


def mod_11_bounded_forest(spark: SparkSession, d: str) -> DataFrame:
    """Splits and gain of each column, least rows of a leaf, and leaves of the largest tree."""
    _, forest = bounded_forest(spark, d)
    leaves = forest.table.where("column is null")
    held = leaves.groupBy("tree").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("leaves")).agg(F.min("least").alias("least_leaf"), F.max("leaves").alias("most_leaves"))
    return forest.importance().join(F.broadcast(held)).withColumn("gain", F.round("gain", 4))


def mod_12_bounded_score(spark: SparkSession, d: str) -> DataFrame:
    """Days that the bounded forest was not fitted on, scored from its table of nodes."""
    x, forest = bounded_forest(spark, d)
    s = trees.scored(x.where(F.col("day") >= SPLIT), forest.table, COLUMNS, forest.depth, forest.base)
    return s.groupBy("system_id", "h_min").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("w") * F.pow(F.col("p_forest") - F.col("y"), 2)) / F.sum("w"), 6).alias("brier"))


#: An imported forest: tree, node, column, threshold, nan_left, codes, left, right, value.
IMPORTED = [
    (0, 0, "bikes", 2.5, False, None, 1, 2, None),
    (0, 1, "p1000", 400.0, True, None, 3, 4, None),
    (0, 2, "kind", None, None, [0, 2], 5, 6, None),
    (0, 3, None, None, None, None, None, None, -0.75),
    (0, 4, None, None, None, None, None, None, -0.25),
    (0, 5, None, None, None, None, None, None, 0.5),
    (0, 6, None, None, None, None, None, None, 0.125),
    (1, 0, "p1000", 650.0, False, None, 1, 2, None),
    (1, 1, "bucket", None, None, [1, 4], 3, 4, None),
    (1, 2, None, None, None, None, None, None, 0.375),
    (1, 3, "h_min", 15.0, True, None, 5, 6, None),
    (1, 4, None, None, None, None, None, None, -0.5),
    (1, 5, None, None, None, None, None, None, 0.25),
    (1, 6, None, None, None, None, None, None, -0.125),
]


def mod_12_node_walk(spark: SparkSession, d: str) -> DataFrame:
    """All rows, with nulls among numbers and codes, scored by an imported table of nodes."""
    hole = lambda c, k: F.when(F.col("minute") % k != 0, F.col(c)).alias(c)
    x = forest_rows(spark, d).select("system_id", "minute", "bikes", "h_min", "bucket", hole("p1000", 7), hole("kind", 11))
    table = spark.createDataFrame([(*r, None, None) for r in IMPORTED], trees.NODES)
    s = trees.scored(x, table, COLUMNS, 3)
    return s.groupBy("system_id", "h_min", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_forest"), 9).alias("mean_p"), F.round(F.min("p_forest"), 9).alias("least_p"), F.round(F.max("p_forest"), 9).alias("most_p"))


SAMPLE_COLUMNS = ["bikes", "docks", "capacity", "h_min", "minute_of_day", "lag_360", "delta_1440", "roll_mean", "rentals", "returns", "bikes_yesterday", "y_yesterday", "nb_bikes", "nb_empty", "precip_target", "temp_c", "prof_p", "prof_n_days", "kind"]


#: What the chain reads of a sample: names and outcomes, and what SAMPLE_COLUMNS are made of.
CHAIN_COLUMNS = [*KEYS, "t", "h_min", "y_bike", "y_dock", "weight", "staleness_s", "target_dow_type", "minute_of_day", "capacity", "bikes", "docks", "lag_360", "delta_1440", "roll_mean", "rentals", "returns", "bikes_yesterday", "y_bike_yesterday", "y_dock_yesterday", "nb_bikes", "nb_empty", "precip_target", "temp_c", "prof_p_bike", "prof_p_dock", "prof_n_days"]


def chain(samples: DataFrame, target: str, count: str) -> DataFrame:
    """Samples of one target with the probabilities of each model of the chain, on the days that no fit saw."""
    kind = F.when(F.col("target_dow_type") == "sat", 0).when(F.col("target_dow_type") == "sun_holiday", 1).otherwise(2)
    x = samples.select("*", F.lit(target).alias("target"), F.col(f"y_{target}").alias("y"), F.col("weight").alias("w"), M.bucket(F.col(count)).alias("bucket"), F.col("target_dow_type").alias("dow_type"), kind.alias("kind"), F.col(f"prof_p_{target}").alias("prof_p"), F.col(f"y_{target}_yesterday").alias("y_yesterday"))
    fit, later = x.where("day <= '2024-01-20'"), x.where("day >= '2024-01-22'")
    base = fit.select(*CLIMATE, "day", "h_min", "bucket", "y", "w")  # a row of the baselines: the rest would be shuffled and written with it
    left_out = M.climatology_leave_day_out(M.conditional_leave_one_out(base, "p_b1"), CLIMATE, 4, TREND_FLOORS, "p_b1", "p_b2")
    blend = M.blend_fit(written(left_out, "blend"))
    forest = M.forest_fit(fit, SAMPLE_COLUMNS, "y", "w", categorical={"kind": 3})
    z = M.conditional_predict(later, M.conditional_fit(base))
    z = M.climatology_predict(z, M.climatology_fit(base, CLIMATE, 4, TREND_FLOORS), CLIMATE, "p_b1")
    z = M.forest_score(M.blend_predict(z, blend), forest, SAMPLE_COLUMNS, categorical={"kind": 3}).withColumn("p_b0", M.persistence(F.col(count)))
    return z.select(*KEYS, "t", "h_min", "day", "target", "bucket", "y", "w", "informed", "staleness_s", "p_b0", "p_b1", "p_b2", "p_b3", "p_forest")


def routed(spark: SparkSession, d: str) -> DataFrame:
    """Samples from observations to the routed probability, for both targets: p_b0 to p_b3, p_forest and p.

    Days up to 20 January fit the baselines, the blend (on left-out baselines) and the forest;
    the next are purged; 22 to 24 January choose the gate; later days are scored. Both targets are fitted
    side by side: a fit is hundreds of short jobs, between which executors would wait.
    """
    samples = written(Q.samples(spark, d, CHAIN_COLUMNS).withColumn("day", timegrid.local_date(F.col("t"), 9)), "samples")
    fits = [inheritable_thread_target(partial(chain, samples, target, count)) for target, count in (("bike", "bikes"), ("dock", "docks"))]
    with ThreadPoolExecutor(len(fits)) as pool:
        parts = list(pool.map(lambda fit: fit(), fits))
    x = written(parts[0].unionByName(parts[1]), "scored")
    g = M.gate(x.where("day <= '2024-01-24'"))
    h = g.groupBy("system_id", "target", "h_min").agg(F.max(F.col("reason") == "routed").alias("routed"))
    return M.composite(x.where("day > '2024-01-24'"), M.gate_table(h, g))


def mod_19_routed_forecast(spark: SparkSession, d: str) -> DataFrame:
    """From observations to the routed forecast: how each model of the chain scores on the days that chose nothing."""
    x = routed(spark, d)
    score = lambda c: F.round(F.sum(F.col("w") * F.pow(F.col(c) - F.col("y"), 2)) / F.sum("w"), 6).alias(c.replace("p_", "brier_") if c != "p" else "brier_routed")
    return x.groupBy("system_id", "target", "h_min").agg(F.count(F.lit(1)).alias("n"), *[score(c) for c in ("p_b0", "p_b1", "p_b2", "p_b3", "p_forest", "p")])


def mod_19_assembled(spark: SparkSession, d: str) -> DataFrame:
    """The routed forecast's arrays of each entity and time."""
    x = routed(spark, d).withColumn("station_id", F.concat_ws("@", "station_id", F.date_format("t", "yyyy-MM-dd HH:mm")))
    both = x.groupBy(*KEYS, "h_min").agg(F.max(F.when(F.col("target") == "bike", F.col("p"))).alias("p_bike"), F.max(F.when(F.col("target") == "dock", F.col("p"))).alias("p_dock"), F.bool_and("informed").alias("informed"))
    return M.assemble(both, F.lit(False))


def gates(spark: SparkSession, d: str) -> DataFrame:
    return M.gate(gate_rows(spark, d))


def mod_13_gate(spark: SparkSession, d: str) -> DataFrame:
    return gates(spark, d).withColumn("gain", F.round("gain", 9))


COST = {"a": 1.35}  #: what a row of a system costs in the forest, relative to others


def held_out(rows: DataFrame) -> DataFrame:
    """Gain and forest share of every routing unit, chosen and measured on all days, and chosen on the first and measured on the rest; the means have null system and target."""
    _, measured = routing.judge(rows, COST)
    each = measured.select("mode", "unit", "system_id", "target", "n", F.round("brier_b3", 9).alias("brier_b3"), F.round("brier_served", 9).alias("brier_served"), F.round("gain", 9).alias("gain"), F.round(F.col("forest_cost") / F.col("whole_cost"), 9).alias("forest_share"))
    return each.unionByName(routing.summary(measured).withColumns({"gain": F.round("gain", 9), "forest_share": F.round("forest_share", 9)}), allowMissingColumns=True)


def mod_13_holdout(spark: SparkSession, d: str) -> DataFrame:
    return held_out(gate_rows(spark, d).where("day >= DATE '1995-01-01'").withColumn("day", F.year("day")))


def mod_13_units(spark: SparkSession, d: str) -> DataFrame:
    """What each unit decides for every cell, and why."""
    x = gate_rows(spark, d).withColumn("day", F.year("day"))
    return routing.chosen(routing.part_sums(x))


def mod_19_holdout(spark: SparkSession, d: str) -> DataFrame:
    """The routing units on the forecasts of the whole chain."""
    return held_out(routed(spark, d))


def table(spark: SparkSession, d: str) -> DataFrame:
    g = gates(spark, d)
    h = g.groupBy("system_id", "target", "h_min").agg(F.max(F.col("reason") == "routed").alias("routed"))
    return M.gate_table(h, g.where("bucket <> 2"))


def mod_14_gate_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d)


def mod_15_composite(spark: SparkSession, d: str) -> DataFrame:
    x = M.composite(gate_rows(spark, d), table(spark, d))
    return x.groupBy("system_id", "h_min").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 9).alias("mean_p"))


def mod_16_assembly(spark: SparkSession, d: str) -> DataFrame:
    x = rows(spark, d).groupBy(*KEYS, "h_min").agg((F.sum("p1000") / F.count(F.lit(1)) / 1000).alias("p_bike"), (F.sum("q1000") / F.count(F.lit(1)) / 1000).alias("p_dock"), (F.count(F.lit(1)) > 140).alias("informed"))
    out = M.assemble(x, F.col("station_id").cast("long") % 10 == 0)
    return out.withColumn("p_bike_x1000", F.transform("p_bike_x1000", lambda v: v.cast("int"))).withColumn("p_dock_x1000", F.transform("p_dock_x1000", lambda v: v.cast("int")))


def mod_17_drop_cells(spark: SparkSession, d: str) -> DataFrame:
    x = rows(spark, d).withColumn("target", F.lit("bike"))
    m = x.groupBy("system_id", "target", "h_min", "bucket", F.col("day").alias("metric_date"), F.when(F.col("minute") % 2 == 0, "composite").otherwise("b3").alias("model_version")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p1000") / 1000 - F.col("y"), 2)).alias("brier"))
    carried = x.where("bucket = 0 and h_min = 5").select("system_id", "target", "h_min", "bucket").distinct()
    return M.drop_cells(m, F.to_date(F.lit("1998-01-02")), carried)


def mod_18_thickness(spark: SparkSession, d: str) -> DataFrame:
    return M.thickness(M.climatology_fit(fit_rows(spark, d), CLIMATE, 30, FLOORS))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("mod_")}

B = "CASE WHEN bikes <= 0 THEN 0 WHEN bikes = 1 THEN 1 WHEN bikes = 2 THEN 2 WHEN bikes <= 5 THEN 3 WHEN bikes <= 10 THEN 4 ELSE 5 END"
ROWS = f"{T.SCORES}, rows AS (SELECT *, {B} AS bucket FROM scores), fit AS (SELECT * FROM rows WHERE day < DATE '{SPLIT}')"
B1 = """c1 AS (SELECT system_id, h_min, bucket, sum(w * y) / sum(w)::DOUBLE AS r FROM fit GROUP BY ALL)"""
FLOOR = "CASE dow_type WHEN 'weekday' THEN 3 ELSE 4 END"
CELLS = f"cells AS (SELECT *, n_rows >= 30 AND n_days >= {FLOOR} AS usable FROM (SELECT system_id, station_id, dow_type, count(*) AS n_rows, count(DISTINCT day) AS n_days, sum(w * y) / sum(w)::DOUBLE AS rate FROM fit GROUP BY ALL))"
GATE = f"""{T.SCORES}, rows AS (SELECT *, {B} AS bucket FROM scores), g0 AS (SELECT *, 'bike' AS target, CASE WHEN h_min = 5 THEN y ELSE (bikes >= 1)::INT END::DOUBLE AS p_b0,
  CASE WHEN h_min = 60 THEN y * 0.6::DOUBLE + q1000 * 0.0004::DOUBLE ELSE y * 0.5::DOUBLE + p1000 * 0.0005::DOUBLE END AS p_b3, CASE WHEN bucket = 3 THEN q1000 / 1000.0::DOUBLE ELSE y * 0.7::DOUBLE + q1000 * 0.0003::DOUBLE END AS p_forest FROM rows),
cell AS (SELECT system_id, target, h_min, bucket, count(*) AS n, sum(w) AS w, sum(w * pow(p_b0 - y, 2)) AS e0, sum(w * pow(p_b3 - y, 2)) AS e3, sum(w * pow(p_forest - y, 2)) AS ef FROM g0 GROUP BY ALL),
hor AS (SELECT system_id, target, h_min, sum(e0) / sum(w) AS b0, 1 - (sum(ef) / sum(w)) / (sum(e3) / sum(w)) AS gain FROM cell GROUP BY ALL),
gate AS (SELECT c.system_id, c.target, c.h_min, bucket, n, CASE WHEN b0 < 0.001 THEN 'too_easy' WHEN gain < 0.1 THEN 'gain_too_small' ELSE 'routed' END AS reason, gain, (CASE WHEN b0 < 0.001 THEN 'too_easy' WHEN gain < 0.1 THEN 'gain_too_small' ELSE 'routed' END) = 'routed' AND ef <= e3 AS to_forest FROM cell c JOIN hor h USING (system_id, target, h_min)),
tab AS (SELECT h.system_id, h.target, h.h_min, h.routed, b.bucket, coalesce(g.to_forest, h.routed) AS to_forest FROM (SELECT system_id, target, h_min, bool_or(reason = 'routed') AS routed FROM gate GROUP BY ALL) h CROSS JOIN (SELECT unnest(range(6))::INT AS bucket) b
  LEFT JOIN gate g ON g.system_id = h.system_id AND g.target = h.target AND g.h_min = h.h_min AND g.bucket = b.bucket AND g.bucket <> 2)"""

UNITS = f"""{GATE}, y0 AS (SELECT *, year(day) AS d FROM g0 WHERE {{days}}), part AS (SELECT system_id, target, h_min, bucket, d = (SELECT min(d) FROM y0) AS is_first, count(*) AS n, sum(w) AS w, sum(w * pow(p_b0 - y, 2)) AS e0, sum(w * pow(p_b3 - y, 2)) AS e3, sum(w * pow(p_forest - y, 2)) AS ef FROM y0 GROUP BY ALL),
choose AS (SELECT 'all' AS mode, * FROM part UNION ALL SELECT 'holdout', * FROM part WHERE is_first),
measure AS (SELECT 'all' AS mode, * FROM part UNION ALL SELECT 'holdout', * FROM part WHERE NOT is_first),
cs AS (SELECT mode, system_id, target, h_min, bucket, sum(w) AS w, sum(e0) AS e0, sum(e3) AS e3, sum(ef) AS ef FROM choose GROUP BY ALL),
hs AS (SELECT mode, system_id, target, h_min, sum(w) AS w, sum(e0) AS e0, sum(e3) AS e3, sum(ef) AS ef FROM choose GROUP BY ALL),
cr AS (SELECT *, CASE WHEN e0 < 0.001 * w THEN 'excluded' WHEN e3 > 0 AND (e3 - ef) / e3 >= 0.1 THEN 'passed' ELSE 'below' END AS cell_reason FROM cs),
hr AS (SELECT *, CASE WHEN e0 < 0.001 * w THEN 'excluded' WHEN e3 > 0 AND (e3 - ef) / e3 >= 0.1 THEN 'passed' ELSE 'below' END AS horizon_reason FROM hs),
decided AS (SELECT c.mode, c.system_id, c.target, c.h_min, c.bucket, cell_reason, horizon_reason, u.unit, CASE u.unit WHEN 'none' THEN true WHEN 'cell' THEN cell_reason = 'passed' ELSE horizon_reason = 'passed' AND NOT (cell_reason <> 'excluded' AND c.ef > c.e3) END AS to_forest
  FROM cr c JOIN hr h ON h.mode = c.mode AND h.system_id = c.system_id AND h.target = c.target AND h.h_min = c.h_min CROSS JOIN (SELECT unnest(['none', 'horizon', 'cell']) AS unit) u)"""
HOLDOUT = f"""WITH {UNITS.format(days="day >= DATE '1995-01-01'")}, m AS (SELECT m.*, u.unit, coalesce(d.to_forest, u.unit = 'none') AS f, CASE WHEN m.system_id = 'a' THEN 1.35 ELSE 1 END::DOUBLE AS price FROM measure m CROSS JOIN (SELECT unnest(['none', 'horizon', 'cell']) AS unit) u
  LEFT JOIN decided d ON d.mode = m.mode AND d.unit = u.unit AND d.system_id = m.system_id AND d.target = m.target AND d.h_min = m.h_min AND d.bucket = m.bucket),
each AS (SELECT mode, unit, system_id, target, sum(n)::BIGINT AS n, sum(e3) / sum(w) AS b3, sum(CASE WHEN f THEN ef ELSE e3 END) / sum(w) AS bs, sum(CASE WHEN f THEN n * price ELSE 0 END) AS fc, sum(n * price) AS wc FROM m GROUP BY ALL)
SELECT mode, unit, system_id, target, n, round(b3, 9) AS brier_b3, round(bs, 9) AS brier_served, round(CASE WHEN b3 > 0 THEN 1 - bs / b3 END, 9) AS gain, round(fc / wc, 9) AS forest_share FROM each
UNION ALL SELECT mode, unit, NULL, NULL, sum(n)::BIGINT, NULL, NULL, round(coalesce(avg(CASE WHEN b3 > 0 THEN 1 - bs / b3 END), 0), 9), round(sum(fc) / sum(wc), 9) FROM each GROUP BY mode, unit"""


def _values(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


WALK = f"""WITH RECURSIVE {ROWS}, node(tree, node, col, threshold, nan_left, codes, l, r, value) AS (VALUES {", ".join("(" + ", ".join(map(_values, r)) + ")" for r in IMPORTED)}),
x AS (SELECT row_number() OVER () AS id, system_id, h_min, bucket, bikes::DOUBLE AS bikes, CASE WHEN minute % 7 <> 0 THEN p1000 END::DOUBLE AS p1000, CASE WHEN minute % 11 <> 0 THEN CASE dow_type WHEN 'sat' THEN 0 WHEN 'sun_holiday' THEN 1 ELSE 2 END END AS kind FROM rows),
walk(id, tree, place) AS (SELECT x.id, t.tree, 0 FROM x CROSS JOIN (SELECT DISTINCT tree FROM node) t UNION ALL
  SELECT w.id, w.tree, CASE WHEN CASE WHEN n.codes IS NOT NULL THEN coalesce(list_contains(n.codes, CASE n.col WHEN 'kind' THEN x.kind ELSE x.bucket END), false)
      ELSE coalesce(CASE n.col WHEN 'bikes' THEN x.bikes WHEN 'p1000' THEN x.p1000 ELSE x.h_min END <= n.threshold, n.nan_left) END THEN n.l ELSE n.r END
  FROM walk w JOIN node n ON n.tree = w.tree AND n.node = w.place JOIN x ON x.id = w.id WHERE n.col IS NOT NULL),
p AS (SELECT w.id, 1 / (1 + exp(-sum(n.value))) AS p FROM walk w JOIN node n ON n.tree = w.tree AND n.node = w.place WHERE n.col IS NULL GROUP BY w.id)
SELECT system_id, h_min, bucket, count(*) AS n, round(avg(p), 9) AS mean_p, round(min(p), 9) AS least_p, round(max(p), 9) AS most_p FROM x JOIN p USING (id) GROUP BY ALL"""

ORACLE = {
    "mod_12_node_walk": WALK,
    "mod_13_holdout": HOLDOUT,
    "mod_13_units": f"WITH {UNITS.format(days='true')} SELECT * FROM decided",
    "mod_00_bucket": f"WITH {ROWS} SELECT bucket, count(*) AS n, min(bikes) AS low, max(bikes) AS high FROM rows GROUP BY 1",
    "mod_01_persistence": f"WITH {ROWS} SELECT h_min, round(sum(w * pow((bikes >= 1)::INT - y, 2)) / sum(w), 9) AS brier FROM rows GROUP BY 1",
    "mod_02_conditional": f"""WITH {ROWS}, f AS (SELECT * FROM fit WHERE NOT (h_min = 60 AND bucket = 5)), c AS (SELECT system_id, h_min, bucket, sum(w * y) / sum(w)::DOUBLE AS r FROM f GROUP BY ALL), h AS (SELECT system_id, h_min, sum(w * y) / sum(w)::DOUBLE AS r FROM f GROUP BY ALL)
SELECT x.system_id, x.h_min, x.bucket, count(*) AS n, round(max(coalesce(c.r, h.r)), 9) AS p_b1 FROM rows x LEFT JOIN c USING (system_id, h_min, bucket) LEFT JOIN h ON h.system_id = x.system_id AND h.h_min = x.h_min WHERE day >= DATE '{SPLIT}' GROUP BY ALL""",
    "mod_03_leave_one_out": f"""WITH {ROWS}, s AS (SELECT *, sum(w) OVER c AS sw, sum(w * y) OVER c AS sy, sum(w) OVER h AS hw, sum(w * y) OVER h AS hy FROM fit WINDOW c AS (PARTITION BY system_id, h_min, bucket), h AS (PARTITION BY system_id, h_min)),
p AS (SELECT *, CASE WHEN sw > w THEN (sy - w * y) / (sw - w)::DOUBLE ELSE (hy - w * y) / (hw - w)::DOUBLE END AS p FROM s) SELECT system_id, h_min, bucket, round(avg(p), 6) AS mean_p, round(max(p), 9) AS max_p FROM p GROUP BY ALL""",
    "mod_04_climatology": f"""WITH {ROWS}, {B1}, {CELLS} SELECT x.system_id, x.dow_type, count(*) FILTER (c.rate IS NOT NULL) AS n_informed, count(*) AS n, round(avg(coalesce(c.rate, c1.r)), 6) AS mean_p FROM rows x LEFT JOIN c1 ON c1.system_id = x.system_id AND c1.h_min = x.h_min AND c1.bucket = x.bucket
LEFT JOIN cells c ON c.system_id = x.system_id AND c.station_id = x.station_id AND c.dow_type = x.dow_type AND usable WHERE day >= DATE '{SPLIT}' GROUP BY ALL""",
    "mod_05_leave_day_out": f"""WITH {ROWS}, {B1}, dd AS (SELECT system_id, station_id, dow_type, day, count(*) AS n, sum(w) AS w, sum(w * y) AS wy FROM fit GROUP BY ALL), cc AS (SELECT system_id, station_id, dow_type, sum(n) AS n, count(*) AS k, sum(w) AS w, sum(wy) AS wy FROM dd GROUP BY ALL),
o AS (SELECT f.system_id, f.dow_type, CASE WHEN cc.n - dd.n >= 30 AND cc.k - 1 >= CASE f.dow_type WHEN 'weekday' THEN 2 ELSE 3 END AND cc.w - dd.w > 0 THEN (cc.wy - dd.wy) / (cc.w - dd.w)::DOUBLE ELSE c1.r END AS p FROM fit f
  JOIN dd USING (system_id, station_id, dow_type, day) JOIN cc USING (system_id, station_id, dow_type) JOIN c1 ON c1.system_id = f.system_id AND c1.h_min = f.h_min AND c1.bucket = f.bucket)
SELECT system_id, dow_type, count(*) AS n, round(avg(p), 6) AS mean_p, round(min(p), 6) AS min_p FROM o GROUP BY ALL""",
    "mod_07_trend": f"""WITH {Q.STATE}, {Q.FLOW}, {Q.PROFILE}, {Q.PROF}, c AS (SELECT system_id, station_id, dow_type, (slot15 // 2)::INT AS hour, sum(n)::BIGINT AS n, sum(n_bike_ok)::BIGINT AS n_ok, min(n_days) AS n_days FROM prof GROUP BY ALL)
SELECT *, round(CASE WHEN n_days >= CASE dow_type WHEN 'weekday' THEN 3 ELSE 2 END THEN n_ok / n::DOUBLE END, 9) AS rate, round(sum(n_ok) OVER (PARTITION BY system_id, station_id) / sum(n) OVER (PARTITION BY system_id, station_id)::DOUBLE, 9) AS port_rate FROM c""",
    "mod_08_lagged_pairs": f"""WITH {T.OBS}, d AS (SELECT DISTINCT (observed_at + INTERVAL 9 HOUR)::DATE AS day FROM obs), p AS (SELECT day AS published, day - k::INT AS day, day - k::INT - 2 AS edition FROM d, (SELECT unnest(range(7)) AS k) WHERE day(d.day) >= 15)
SELECT * FROM p WHERE edition IN (SELECT day FROM d)""",
    "mod_13_gate": f"WITH {GATE} SELECT system_id, target, h_min, bucket, n, reason, round(gain, 9) AS gain, to_forest FROM gate",
    "mod_14_gate_table": f"WITH {GATE} SELECT * FROM tab",
    "mod_15_composite": f"WITH {GATE} SELECT g.system_id, g.h_min, count(*) AS n, round(avg(CASE WHEN to_forest THEN p_forest ELSE p_b3 END), 9) AS mean_p FROM g0 g LEFT JOIN tab t ON t.system_id = g.system_id AND t.h_min = g.h_min AND t.bucket = g.bucket GROUP BY ALL",
    "mod_16_assembly": f"""WITH {ROWS}, a AS (SELECT system_id, station_id, h_min, round_even(sum(p1000) / count(*)::DOUBLE / 1000 * 1000, 0)::INT AS b, round_even(sum(q1000) / count(*)::DOUBLE / 1000 * 1000, 0)::INT AS d, count(*) > 140 AS inf FROM rows GROUP BY ALL)
SELECT system_id, station_id, list(h_min ORDER BY h_min) AS horizons_min, list(b ORDER BY h_min) AS p_bike_x1000, list(d ORDER BY h_min) AS p_dock_x1000, CASE WHEN any_value(station_id)::BIGINT % 10 = 0 THEN 1 WHEN count(*) FILTER (inf) * 2 > count(*) THEN 3 ELSE 2 END AS confidence FROM a GROUP BY ALL""",
    "mod_17_drop_cells": f"""WITH {ROWS}, x AS (SELECT * FROM rows), m AS (SELECT system_id, h_min, bucket, day, minute % 2 = 0 AS comp, count(*) AS n, avg(pow(p1000 / 1000.0::DOUBLE - y, 2)) AS b FROM x GROUP BY ALL),
w AS (SELECT system_id, h_min, bucket FROM m WHERE day - DATE '1998-01-02' BETWEEN 1 AND 7 GROUP BY ALL HAVING sum(CASE WHEN comp THEN n * b END) / sum(CASE WHEN comp THEN n END) > sum(CASE WHEN NOT comp THEN n * b END) / sum(CASE WHEN NOT comp THEN n END))
SELECT system_id, 'bike' AS target, h_min, bucket FROM w UNION SELECT DISTINCT system_id, 'bike', h_min, bucket FROM x WHERE bucket = 0 AND h_min = 5""",
    "mod_18_thickness": f"WITH {ROWS}, {CELLS} SELECT dow_type, max(n_days) AS max_days, count(*) FILTER (usable) AS n_usable, count(*) AS n_cells FROM cells GROUP BY ALL",
}
