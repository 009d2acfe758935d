"""Which rows the forest serves: routing units side by side, chosen and measured on days apart.

Rows have system_id, target, h_min, bucket, day, y, w, p_b0, p_b3 and p_forest. Everything
after the first aggregate works on cells (system, target, horizon, bucket) and days' parts, whose number
the settings bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZON = ["system_id", "target", "h_min"]
CELL = [*HORIZON, "bucket"]
UNITS = ("none", "horizon", "cell")


def part_sums(rows: DataFrame) -> DataFrame:
    """Weighted squared errors of each cell on the first day and on the others."""
    err = lambda c: F.sum(F.col("w") * F.pow(F.col(c) - F.col("y"), 2))
    first = rows.agg(F.min("day").alias("first_day"))
    parted = rows.join(F.broadcast(first)).withColumn("is_first", F.col("day") == F.col("first_day"))
    return parted.groupBy(*CELL, "is_first").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), err("p_b0").alias("e0"), err("p_b3").alias("e3"), err("p_forest").alias("ef"))


def reason(least_brier: float, least_gain: float) -> Column:
    """excluded: persistence leaves nothing to improve; below: the forest improves on B3 too little; passed."""
    gain = F.try_divide(F.col("e3") - F.col("ef"), F.col("e3"))
    return F.when(F.col("e0") < least_brier * F.col("w"), "excluded").when(F.coalesce(gain, F.lit(-1.0)) >= least_gain, "passed").otherwise("below")


def chosen(parts: DataFrame, least_brier: float = 0.001, least_gain: float = 0.1) -> DataFrame:
    """mode, unit, cell and to_forest, from the rows of each mode's choosing part.

    ``all`` chooses on every day; ``holdout`` on the first, and exists only with more days. Unit ``none`` routes every row,
    ``cell`` the cells that pass, ``horizon`` the cells of passing horizons but for judgeable ones where the forest is worse.
    """
    modes = F.when(F.col("is_first"), F.array(F.lit("all"), F.lit("holdout"))).otherwise(F.array(F.lit("all")))
    sums = [F.sum(c).alias(c) for c in ("n", "w", "e0", "e3", "ef")]
    rows = parts.withColumn("mode", F.explode(modes))
    # One pass for both units: cells, and horizons as cells of the null bucket.
    both = rows.groupingSets([["mode", *CELL], ["mode", *HORIZON]], "mode", *CELL).agg(*sums, F.grouping("bucket").alias("whole"))
    both = both.withColumn("reason", reason(least_brier, least_gain)).withColumn("worse", (F.col("reason") != "excluded") & (F.col("ef") > F.col("e3")))
    cells = both.where("whole = 0").select("mode", *CELL, F.col("reason").alias("cell_reason"), "worse")
    horizons = both.where("whole = 1").select("mode", *HORIZON, F.col("reason").alias("horizon_reason"))
    every = cells.join(horizons, ["mode", *HORIZON])
    horizon = (F.col("horizon_reason") == "passed") & ~F.col("worse")
    each = F.array(F.struct(F.lit("none").alias("unit"), F.lit(True).alias("to_forest")), F.struct(F.lit("horizon").alias("unit"), horizon.alias("to_forest")), F.struct(F.lit("cell").alias("unit"), (F.col("cell_reason") == "passed").alias("to_forest")))
    return every.select("mode", *CELL, "cell_reason", "horizon_reason", F.explode(each).alias("u")).select("mode", *CELL, "cell_reason", "horizon_reason", "u.*")


def served(parts: DataFrame, decisions: DataFrame, cost: dict[str, float] | None = None) -> DataFrame:
    """mode, unit, system, target: Brier scores of B3 and of what is served on the measured part, the gain, and the forest's rows weighted by what a row costs.

    A cell that the choosing part did not hold goes to the horizon's decision there is none of: B3 (to the forest in unit ``none``).
    """
    modes = F.when(F.col("is_first"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("holdout")))
    units = F.array(*[F.lit(u) for u in UNITS])
    rows = parts.withColumn("mode", F.explode(modes)).withColumn("unit", F.explode(units))
    rows = rows.join(decisions.select("mode", "unit", *CELL, "to_forest"), ["mode", "unit", *CELL], "left")
    to = F.coalesce("to_forest", F.col("unit") == "none")
    price = F.lit(1.0)
    for system, value in (cost or {}).items():
        price = F.when(F.col("system_id") == system, F.lit(value)).otherwise(price)
    group = rows.groupBy("mode", "unit", "system_id", "target").agg(
        F.sum("n").alias("n"),
        (F.sum("e3") / F.sum("w")).alias("brier_b3"),
        (F.sum(F.when(to, F.col("ef")).otherwise(F.col("e3"))) / F.sum("w")).alias("brier_served"),
        F.sum(F.when(to, F.col("n")).otherwise(0) * price).alias("forest_cost"),
        F.sum(F.col("n") * price).alias("whole_cost"),
    )
    return group.withColumn("gain", F.when(F.col("brier_b3") > 0, 1 - F.col("brier_served") / F.col("brier_b3")))


def summary(measured: DataFrame) -> DataFrame:
    """mode, unit: the mean gain over systems and targets (those without a measurable one left out) and the forest's share of the cost."""
    return measured.groupBy("mode", "unit").agg(F.coalesce(F.avg("gain"), F.lit(0.0)).alias("gain"), F.sum("n").alias("n"), (F.sum("forest_cost") / F.sum("whole_cost")).alias("forest_share"))


def judge(rows: DataFrame, cost: dict[str, float] | None = None, least_brier: float = 0.001, least_gain: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(decisions, measured) of every unit and mode."""
    parts = part_sums(rows)
    decisions = chosen(parts, least_brier, least_gain)
    return decisions, served(parts, decisions, cost)
