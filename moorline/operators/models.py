"""Baseline tables, trends, calibration, gates and forecast assembly as data jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.functions.scores import bucket, logit, persistence, x1000  # noqa: F401
from moorline.operators import evaluation, grouped

KEYS = ["system_id", "station_id"]
BUCKETS = ("0", "1", "2", "3-5", "6-10", "11+")


def _rate(df: DataFrame, by: list[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias(name))


def conditional_fit(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weighted rates by (system, horizon, bucket), by (system, horizon), and over all (0.5 of nothing)."""
    total = rows.agg(F.coalesce(F.sum(F.col("w") * F.col("y")) / F.sum("w"), F.lit(0.5)).alias("r_all"))
    return _rate(rows, ["system_id", "h_min", "bucket"], "r_cell"), _rate(rows, ["system_id", "h_min"], "r_h"), total


def conditional_predict(rows: DataFrame, fitted: tuple[DataFrame, DataFrame, DataFrame], name: str = "p_b1") -> DataFrame:
    cell, h, total = fitted
    out = rows.join(F.broadcast(cell), ["system_id", "h_min", "bucket"], "left").join(F.broadcast(h), ["system_id", "h_min"], "left").join(F.broadcast(total))
    return out.withColumn(name, F.coalesce("r_cell", "r_h", "r_all")).drop("r_cell", "r_h", "r_all")


def conditional_leave_one_out(rows: DataFrame, name: str = "p_loo") -> DataFrame:
    """Each row's cell rate without itself; a cell of nothing else falls back to the horizon, then to all, also without it.

    Sums are grouped first and joined back, so no task holds a cell's rows.
    """
    levels = [["system_id", "h_min", "bucket"], ["system_id", "h_min"], []]
    out, rates = rows, []
    for i, by in enumerate(levels):
        sums = rows.groupBy(*by).agg(F.sum("w").alias(f"_w{i}"), F.sum(F.col("w") * F.col("y")).alias(f"_y{i}"))
        out = out.join(sums, by) if by else out.join(F.broadcast(sums))
        rest = F.col(f"_w{i}") - F.col("w")
        rates.append(F.when(rest > 0, (F.col(f"_y{i}") - F.col("w") * F.col("y")) / rest))
    return out.withColumn(name, F.coalesce(*rates, F.lit(0.5))).drop(*[f"_{c}{i}" for c in "wy" for i in range(3)])


def climatology_fit(rows: DataFrame, by: list[str], least_rows: int, floors: dict[str, int]) -> DataFrame:
    """Cell rates with row and day counts; ``usable`` when both reach their floors (days by day kind)."""
    floor = F.element_at(F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v))]), F.col("dow_type"))
    cells = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("day").alias("n_days"), F.sum("w").alias("sum_w"), F.sum(F.col("w") * F.col("y")).alias("sum_wy"))
    return cells.withColumn("rate", F.col("sum_wy") / F.col("sum_w")).withColumn("usable", (F.col("n_rows") >= least_rows) & (F.col("n_days") >= floor))


def climatology_predict(rows: DataFrame, cells: DataFrame, by: list[str], fallback: str, name: str = "p_b2") -> DataFrame:
    out = rows.join(cells.where("usable").select(*by, F.col("rate").alias("_r")), by, "left")
    return out.withColumn(name, F.coalesce("_r", fallback)).withColumn("informed", F.col("_r").isNotNull()).drop("_r")


def climatology_leave_day_out(rows: DataFrame, by: list[str], least_rows: int, floors: dict[str, int], fallback: str, name: str = "p_b2_out") -> DataFrame:
    """Cell rates without the row's own arrival day; floors are tested again after it is taken away, the day floor one lower."""
    floor = F.element_at(F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v - 1))]), F.col("dow_type"))
    day = rows.groupBy(*by, "day").agg(F.count(F.lit(1)).alias("_dn"), F.sum("w").alias("_dw"), F.sum(F.col("w") * F.col("y")).alias("_dy"))
    cell = day.groupBy(*by).agg(F.sum("_dn").alias("_n"), F.count(F.lit(1)).alias("_d"), F.sum("_dw").alias("_w"), F.sum("_dy").alias("_y"))
    rest = day.join(cell, by).select(*by, "day", (F.col("_n") - F.col("_dn")).alias("_rn"), (F.col("_d") - 1).alias("_rd"), (F.col("_w") - F.col("_dw")).alias("_rw"), (F.col("_y") - F.col("_dy")).alias("_ry"))
    out = rows.join(rest, [*by, "day"])
    ok = (F.col("_rn") >= least_rows) & (F.col("_rd") >= floor) & (F.col("_rw") > 0)
    return out.withColumn(name, F.when(ok, F.col("_ry") / F.col("_rw")).otherwise(F.col(fallback))).drop("_rn", "_rd", "_rw", "_ry")


def thickness(cells: DataFrame) -> DataFrame:
    """Most contributing days and usable cells by day kind."""
    return cells.groupBy("dow_type").agg(F.max("n_days").alias("max_days"), F.count_if("usable").alias("n_usable"), F.count(F.lit(1)).alias("n_cells"))


def blend_features() -> list[Column]:
    return [logit(F.col("p_b1")), logit(F.col("p_b2")), F.col("h_min") / 180]


def blend_fit(rows: DataFrame, by: list[str] | None = None, label: str = "y", weight: str = "w") -> DataFrame:
    """Coefficients of a weighted logistic regression on the logits of two baselines and the horizon, for each group of ``by``."""
    return grouped.logistic(rows, by or [], blend_features(), label, weight)


def blend_predict(rows: DataFrame, coefficients: DataFrame, by: list[str] | None = None, name: str = "p_b3") -> DataFrame:
    return grouped.predicted(rows, coefficients, by or [], blend_features(), name)


def hourly_trend(profile: DataFrame, slots_per_hour: int, floors: dict[str, int]) -> DataFrame:
    """Profile slots folded to hours: sums, least days over the slots present, rates of usable cells (bikes and docks), and the port's rates over all."""
    floor = F.element_at(F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v))]), F.col("dow_type"))
    cells = profile.groupBy(*KEYS, "dow_type", F.floor(F.col("slot15") / slots_per_hour).cast("int").alias("hour")).agg(F.sum("n").alias("n"), F.sum("n_bike_ok").alias("n_ok"), F.sum("n_dock_ok").alias("n_dock_ok"), F.min("n_days").alias("n_days"))
    port = cells.groupBy(*KEYS).agg((F.sum("n_ok") / F.sum("n")).alias("port_rate"), (F.sum("n_dock_ok") / F.sum("n")).alias("port_rate_dock"))
    rate = lambda c: F.when(F.col("n_days") >= floor, F.col(c) / F.col("n"))
    return cells.withColumn("rate", rate("n_ok")).withColumn("rate_dock", rate("n_dock_ok")).join(port, KEYS)


def lagged_pairs(days: DataFrame, first: int, last: int, lag: int) -> DataFrame:
    """Pairs (day, edition) with the edition ``lag`` days before, for days between ``first`` and ``last`` days before each published day P."""
    rows = days.select(F.col("day").alias("published")).distinct().select("published", F.explode(F.sequence(F.date_sub("published", first), F.date_sub("published", last))).alias("day"))
    return rows.withColumn("edition", F.date_sub("day", lag))


def trend_rows(daily: DataFrame, pairs: DataFrame, days: int, slots_per_hour: int, floors: dict[str, int]) -> DataFrame:
    """What an edition said of an arrival day, and what came: rows (keys, target, edition, day, dow_type, hour, rate, port_rate, y, w).

    ``pairs(day, edition)`` is a short list of days. The edition's trend is the fold of the
    ``days`` daily profiles up to it; y is the realised rate of the day's points and w their
    number. Hours whose edition is too thin have no row.
    """
    sums = ["n", "n_bike_ok", "n_dock_ok"]
    wanted = F.broadcast(pairs.select("edition").distinct())
    fed = daily.withColumn("edition", F.explode(F.sequence("day", F.date_add("day", days - 1)))).join(wanted, "edition", "left_semi")
    cells = fed.groupBy("edition", *KEYS, "dow_type", "slot15").agg(F.count(F.lit(1)).alias("n_days"), *[F.sum(c).alias(c) for c in sums])
    floor = F.element_at(F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v))]), F.col("dow_type"))
    hour = F.floor(F.col("slot15") / slots_per_hour).cast("int").alias("hour")
    hours = cells.groupBy("edition", *KEYS, "dow_type", hour).agg(F.min("n_days").alias("n_days"), *[F.sum(c).alias(c) for c in sums])
    port = hours.groupBy("edition", *KEYS).agg(*[F.sum(c).alias(f"p_{c}") for c in sums])
    said = hours.where(F.col("n_days") >= floor).join(port, ["edition", *KEYS])
    came = daily.groupBy("day", *KEYS, "dow_type", hour).agg(*[F.sum(c).alias(f"a_{c}") for c in sums])
    came = came.join(F.broadcast(pairs.select("day", "edition").distinct()), "day")
    x = came.join(said, ["edition", *KEYS, "dow_type", "hour"]).where("a_n > 0")
    each = F.array(*[F.struct(F.lit(t).alias("target"), (F.col(c) / F.col("n")).alias("rate"), (F.col(f"p_{c}") / F.col("p_n")).alias("port_rate"), (F.col(f"a_{c}") / F.col("a_n")).alias("y")) for t, c in (("bike", "n_bike_ok"), ("dock", "n_dock_ok"))])
    return x.select(*KEYS, "edition", "day", "dow_type", "hour", F.col("a_n").cast("double").alias("w"), F.explode(each).alias("z")).select(*KEYS, "edition", "day", "dow_type", "hour", "z.*", "w")


def binomial(rows: DataFrame) -> DataFrame:
    """Rows of a rate y and a weight w as two rows with outcomes 1 and 0 that share the weight."""
    both = F.array(F.struct(F.lit(1).alias("y"), (F.col("w") * F.col("y")).alias("w")), F.struct(F.lit(0).alias("y"), (F.col("w") * (1 - F.col("y"))).alias("w")))
    return rows.withColumn("_b", F.explode(both)).drop("y", "w").select("*", "_b.*").drop("_b").where("w > 0")


def calibration_features() -> list[Column]:
    """Logits of the rate and of the port's rate, and on days off the same and an intercept of their own."""
    a, b, off = logit(F.col("rate")), logit(F.col("port_rate")), (F.col("dow_type") != "weekday").cast("double")
    return [a, b, off, a * off, b * off]


def calibrate(rows: DataFrame, by: list[str], label: str = "y", weight: str = "w") -> grouped.Calibration:
    """Logistic on six features, then a monotone fit of its output over bins of equal weight, for each group; the label may be a rate."""
    return grouped.calibrate(rows, by, calibration_features(), label, weight)


def calibrated(rows: DataFrame, fit: grouped.Calibration, name: str = "p_trend") -> DataFrame:
    return grouped.calibrated(rows, fit, name)


MOST_ECE = 0.03


def trend_gate(rows: DataFrame, p: str, port: str, bins: int = 15, most_ece: float = MOST_ECE) -> DataFrame:
    """Groups (system, target) whose calibrated trend, on rows that no part of it was fitted on, has an ECE (bins of equal weight) below the bound and a better Brier score than the port mean."""
    by = ["system_id", "target"]
    error = evaluation.ece(evaluation.reliability_quantile(rows.withColumn("p1000", F.rint(F.col(p) * 1000).cast("int")), by, bins), by)
    score = rows.groupBy(*by).agg(evaluation.brier(F.col(p), F.col("y"), F.col("w")).alias("brier"), evaluation.brier(F.col(port), F.col("y"), F.col("w")).alias("brier_port"))
    out = error.join(score, by)
    return out.withColumn("passes", (F.col("ece") < most_ece) & (F.col("brier") < F.col("brier_port")))


def trend_arrays(rows: DataFrame, p: str) -> DataFrame:
    """72 values (day kinds in sorted order x 24 hours) for each entity; missing cells are null."""
    kind = F.when(F.col("dow_type") == "sat", 0).when(F.col("dow_type") == "sun_holiday", 1).otherwise(2)
    cells = rows.groupBy(*KEYS, (kind * 24 + F.col("hour")).alias("i")).agg(F.max(x1000(F.col(p))).alias("v"))
    maps = cells.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    return maps.select(*KEYS, F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.element_at("m", i)).alias("p_x1000"))


def forest_fit(rows: DataFrame, columns: list[str], label: str, weight: str, trees: int = 20, rate: float = 0.15, depth: int = 5, categorical: dict[str, int] | None = None):  # noqa: ANN201
    """Gradient-boosted trees. Numeric columns (null is told apart by a flag column) and ``categorical`` ones: {column: number of codes}, codes from 0, split by subsets, null a category of its own."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    codes = categorical or {}
    x = forest_design(rows, columns, codes)
    stages = [VectorAssembler(inputCols=forest_inputs(columns, codes), outputCol="features"), GBTClassifier(labelCol=label, weightCol=weight, maxIter=trees, stepSize=rate, maxDepth=depth, maxBins=max(32, *[n + 1 for n in codes.values()], 2), seed=7)]
    return Pipeline(stages=stages).fit(x.withColumn(label, F.col(label).cast("double")))


def forest_cells(rows: DataFrame, columns: list[str], label: str, weight: str, categorical: dict[str, int] | None = None, bins: int = 32) -> DataFrame:
    """The rows as weighted cells for ``forest_fit``: columns, label and the sum of the weights of all rows that its trees cannot tell apart.

    Trees cut a number into at most ``bins`` parts, so numbers of more values are cut beforehand, at quantiles of all rows,
    and each stands as the least value of its part. A tree's sums over cells are those over rows, and cells are
    bounded by the bins, whatever the rows. It pays for few columns; with many, nearly every row is a cell of its own.
    """
    numbers = [c for c in columns if c not in (categorical or {})]
    cuts = forest_cuts(rows, numbers, bins)

    def part(c: Column, least: list[float]) -> Column:
        """The greatest of ``least`` that c reaches, by halves."""
        if len(least) == 1:
            return F.lit(least[0])
        half = len(least) // 2
        return F.when(c < least[half], part(c, least[:half])).otherwise(part(c, least[half:]))

    held = {c: F.when(F.col(c).isNotNull(), part(F.col(c), v)).alias(c) for c, v in cuts.items()}
    kept = rows.where(F.col(label).isNotNull() & F.col(weight).isNotNull())
    return kept.select(*[held.get(c, F.col(c)) for c in columns], label, weight).groupBy(*columns, label).agg(F.sum(weight).alias(weight))


def forest_cuts(rows: DataFrame, numbers: list[str], bins: int) -> dict[str, list[float]]:
    """Least values of the parts of each number that has more than ``bins`` values, by quantiles of all rows."""
    if not numbers:
        return {}
    values = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in numbers]).first()
    wide = [c for c in numbers if values[c] > bins * 0.75]  # the count may be too low by a few parts in a hundred
    if not wide:
        return {}
    shares = [i / bins for i in range(1, bins)]
    each = lambda c: F.struct(F.min(F.col(c).cast("double")).alias("least"), F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias("at")).alias(c)
    r = rows.agg(*[each(c) for c in wide]).first()
    return {c: sorted({r[c]["least"], *r[c]["at"]}) for c in wide}


def forest_inputs(columns: list[str], categorical: dict[str, int]) -> list[str]:
    """Names of the assembled inputs, in order."""
    return [n for c in columns for n in ([f"_{c}"] if c in categorical else [f"_{c}", f"_{c}_missing"])]


def forest_design(rows: DataFrame, columns: list[str], categorical: dict[str, int] | None = None) -> DataFrame:
    codes = categorical or {}
    for c in columns:
        if c in codes:
            known = F.col(c).between(0, codes[c] - 1)
            rows = rows.withColumn(f"_{c}", F.when(known, F.col(c)).otherwise(codes[c]).cast("double"))
            rows = rows.withMetadata(f"_{c}", {"ml_attr": {"type": "nominal", "name": f"_{c}", "vals": [str(i) for i in range(codes[c] + 1)]}})
        else:
            rows = rows.withColumn(f"_{c}", F.coalesce(F.col(c).cast("double"), F.lit(-1.0))).withColumn(f"_{c}_missing", F.col(c).isNull().cast("double"))
    return rows


def forest_score(rows: DataFrame, model, columns: list[str], name: str = "p_forest", categorical: dict[str, int] | None = None) -> DataFrame:  # noqa: ANN001
    from pyspark.ml.functions import vector_to_array

    out = model.transform(forest_design(rows, columns, categorical)).withColumn(name, vector_to_array("probability")[1])
    return out.select(*rows.columns, name)


def forest_candidates(fit: DataFrame, judge: DataFrame, columns: list[str], candidates: list[tuple[int, float]], label: str = "y", weight: str = "w", depth: int = 5, categorical: dict[str, int] | None = None) -> DataFrame:
    """Forests of several (trees, rate) fitted on one set of rows and scored on another: trees, rate, brier."""
    out = None
    for trees, rate in candidates:
        s = forest_score(judge, forest_fit(fit, columns, label, weight, trees, rate, depth, categorical), columns, "p", categorical)
        one = s.agg(F.lit(trees).alias("trees"), F.lit(rate).alias("rate"), evaluation.brier(F.col("p"), F.col(label), F.col(weight)).alias("brier"))
        out = one if out is None else out.unionByName(one)
    return out


def gate(rows: DataFrame, least_brier: float = 0.001, least_gain: float = 0.1) -> DataFrame:
    """Routing by (system, target, horizon) and bucket: columns p_b0, p_b3, p_forest, y, w.

    A horizon is routed to the forest when B0's Brier score is worth improving and the
    forest improves on B3 enough; of a routed horizon, buckets where the forest is worse
    stay with B3.
    """
    err = lambda c: F.sum(F.col("w") * F.pow(F.col(c) - F.col("y"), 2))
    cells = rows.groupBy("system_id", "target", "h_min", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), err("p_b0").alias("e0"), err("p_b3").alias("e3"), err("p_forest").alias("ef"))
    h = cells.groupBy("system_id", "target", "h_min").agg((F.sum("e0") / F.sum("w")).alias("brier_b0"), (F.sum("e3") / F.sum("w")).alias("brier_b3"), (F.sum("ef") / F.sum("w")).alias("brier_forest"))
    gain = 1 - F.try_divide(F.col("brier_forest"), F.col("brier_b3"))
    h = h.withColumn("gain", gain).withColumn("reason", F.when(F.col("brier_b0") < least_brier, "too_easy").when(F.coalesce(gain, F.lit(0.0)) < least_gain, "gain_too_small").otherwise("routed"))
    out = cells.join(h, ["system_id", "target", "h_min"])
    return out.select("system_id", "target", "h_min", "bucket", "n", "reason", "gain", ((F.col("reason") == "routed") & (F.col("ef") <= F.col("e3"))).alias("to_forest"))


def gate_table(horizons: DataFrame, cells: DataFrame) -> DataFrame:
    """Every bucket of every horizon: a cell's own decision where there is one, else its horizon's."""
    every = horizons.withColumn("bucket", F.explode(F.array(*[F.lit(i) for i in range(len(BUCKETS))])))
    own = cells.select("system_id", "target", "h_min", "bucket", F.col("to_forest").alias("_cell"))
    return every.join(own, ["system_id", "target", "h_min", "bucket"], "left").withColumn("to_forest", F.coalesce("_cell", "routed")).drop("_cell")


def composite(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The forest's probability where the gate routes there and it has one, else B3's."""
    out = rows.join(F.broadcast(table.select("system_id", "target", "h_min", "bucket", "to_forest")), ["system_id", "target", "h_min", "bucket"], "left")
    to = F.coalesce("to_forest", F.lit(False)) & F.col("p_forest").isNotNull()
    return out.withColumn("p", F.when(to, F.col("p_forest")).otherwise(F.col("p_b3"))).drop("to_forest")


def assemble(rows: DataFrame, stale: Column) -> DataFrame:
    """Forecast rows: arrays by horizon in thousandths, and a confidence: 1 stale, 3 when most horizons are informed for both targets, else 2."""
    item = F.struct("h_min", x1000(F.col("p_bike")).alias("b"), x1000(F.col("p_dock")).alias("d"))
    out = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("_a"), F.count_if("informed").alias("_i"), F.count(F.lit(1)).alias("_n"), F.bool_or(stale).alias("_s"))
    confidence = F.when(F.col("_s"), 1).when(F.col("_i") * 2 > F.col("_n"), 3).otherwise(2)
    part = lambda n: F.transform("_a", lambda x: x[n])
    return out.select(*KEYS, part("h_min").alias("horizons_min"), part("b").alias("p_bike_x1000"), part("d").alias("p_dock_x1000"), confidence.alias("confidence"))


def drop_cells(metrics: DataFrame, promoted: Column, carried: DataFrame, days: int = 7) -> DataFrame:
    """Cells to drop from the composite: worse than B3 over at most ``days`` days after promotion, with those dropped before."""
    cell = ["system_id", "target", "h_min", "bucket"]
    age = F.datediff("metric_date", promoted)
    rows = metrics.where((age > 0) & (age <= days))
    mean = lambda v: F.sum(F.when(F.col("model_version") == v, F.col("n") * F.col("brier"))) / F.sum(F.when(F.col("model_version") == v, F.col("n")))
    worse = rows.groupBy(*cell).agg(mean("composite").alias("c"), mean("b3").alias("b")).where("c > b")
    return worse.select(*cell).unionByName(carried.select(*cell)).distinct()
