"""Exploratory aggregations over observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["system_id", "station_id"]


def observed(obs: DataFrame) -> DataFrame:
    return obs.where((F.col("bikes") != -1) & (F.col("docks") != -1))


def availability(obs: DataFrame) -> DataFrame:
    pct = lambda c: F.round(F.avg(c.cast("double")) * 100, 6)
    b, k = F.col("bikes"), F.col("docks")
    return observed(obs).groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), pct(b == 0).alias("pct_no_bikes"), pct(k == 0).alias("pct_no_docks"), pct((b == 0) & (k == 0)).alias("pct_neither"), F.round(F.avg(b), 6).alias("mean_bikes"), F.round(F.avg(k), 6).alias("mean_docks"), F.max(b).alias("max_bikes"), F.max(k).alias("max_docks"), pct(F.col("flags") == 1).alias("pct_installed_only"))


def missingness(obs: DataFrame, snapshot: Column) -> DataFrame:
    per = obs.groupBy("system_id", snapshot.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bikes") == -1).alias("m"))
    top = per.groupBy("system_id").agg(F.count(F.lit(1)).alias("n_snapshots"), F.count_distinct("n").alias("n_lengths"), F.round(F.sum("m") / F.sum("n") * 100, 6).alias("pct_missing"))
    return top.join(obs.groupBy("system_id").agg(F.count_distinct("station_id").alias("n_stations")), "system_id")


def _moves(obs: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy("observed_at", "fetched_at")
    return observed(obs).withColumn("d", F.col("bikes") - F.lag("bikes").over(w))


def hourly(obs: DataFrame, local_hour: Column, local_day: Column) -> DataFrame:
    x = _moves(obs).withColumn("hour", local_hour).withColumn("day", local_day)
    return x.groupBy("system_id", "hour").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("day").alias("n_days"), F.round(F.avg((F.col("bikes") == 0).cast("double")) * 100, 6).alias("pct_zero"), F.round(F.avg("bikes"), 6).alias("mean_bikes"), F.round(F.avg(F.abs("d")), 6).alias("mean_move"))


def nearest_rank(df: DataFrame, value: str, shares: tuple[float, ...], prefix: str) -> DataFrame:
    """Values at rank bround(share * (n - 1)), ties to even, of the whole table: counts by distinct value first, then one small window."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy(value)
    counts = counts.withColumn("last", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("n", F.sum("c").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pick = lambda s: F.min(F.when(F.col("last") >= F.bround((F.col("n") - 1) * s), F.col(value)))
    return counts.agg(*[pick(s).alias(f"{prefix}_p{int(s * 100)}") for s in shares])


def station_spread(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per station: zero rate and moves, overall counts)."""
    per = _moves(obs).groupBy(*KEYS).agg(F.round(F.avg((F.col("bikes") == 0).cast("double")), 6).alias("zero_rate"), F.coalesce(F.sum(F.abs("d")), F.lit(0)).alias("moves"))
    return per, per.agg(F.count_if(F.col("zero_rate") == 1).alias("always_empty"), F.count_if(F.col("zero_rate") == 0).alias("never_empty"), F.count_if(F.col("moves") == 0).alias("never_changed"), F.max("moves").alias("max_moves"))


def flow_loss(obs: DataFrame, grid: Column) -> DataFrame:
    """Summed moves at native cadence, and over the last row of each entity and grid step."""
    native = _moves(obs).groupBy("system_id").agg(F.sum(F.abs("d")).alias("native"))
    last = observed(obs).groupBy(*KEYS, grid.alias("g")).agg(F.max_by("bikes", F.struct("observed_at", "fetched_at")).alias("bikes"))
    w = Window.partitionBy(*KEYS).orderBy("g")
    coarse = last.withColumn("d", F.col("bikes") - F.lag("bikes").over(w)).groupBy("system_id").agg(F.sum(F.abs("d")).alias("gridded"))
    return native.join(coarse, "system_id").withColumn("pct_lost", F.round((1 - F.col("gridded") / F.col("native")) * 100, 6))


def rebalancing(obs: DataFrame, capacity: DataFrame, local_hour: Column, least: int = 4, share: float = 0.5) -> DataFrame:
    """Moves of at least max(least, share of capacity), by hour."""
    x = _moves(obs).withColumn("hour", local_hour).join(capacity.select(*KEYS, "capacity"), KEYS, "left")
    big = F.abs("d") >= F.greatest(F.lit(float(least)), F.coalesce(F.col("capacity") * share, F.lit(float(least))))
    return x.groupBy("system_id", "hour").agg(F.count_if(big).alias("n_events"), F.count_distinct(F.when(big, F.col("station_id"))).alias("n_stations"), F.round(F.count_if(big) / F.count(F.lit(1)), 6).alias("rate"), F.max(F.when(big, F.abs("d"))).alias("largest"))


def extremes(obs: DataFrame, k: int, implausible: int = 2000) -> DataFrame:
    per = obs.groupBy(*KEYS).agg(F.max("docks").alias("max_docks"), F.max(F.col("bikes") + F.col("docks")).alias("capacity_seen"))
    return per.orderBy(F.col("max_docks").desc(), *KEYS).limit(k).withColumn("is_implausible", F.col("max_docks") >= implausible)


def leave_one_out_mae(values: DataFrame, groups: dict[str, list[str]], value: str) -> DataFrame:
    """Mean absolute error of a group's mean without the row itself, by grouping; groups of one fall to the whole."""
    x = values
    for name, by in groups.items():
        s = values.groupBy(*by).agg(F.sum(value).alias(f"s_{name}"), F.count(F.lit(1)).alias(f"c_{name}"))
        x = x.join(s, by) if by else x.join(F.broadcast(s))
    total = F.try_divide(F.col("s_all") - F.col(value), F.col("c_all") - 1)
    out = []
    for name in groups:
        mean = F.when(F.col(f"c_{name}") > 1, (F.col(f"s_{name}") - F.col(value)) / (F.col(f"c_{name}") - 1)).otherwise(total)
        out.append(F.round(F.avg(F.abs(mean - F.col(value))), 6).alias(f"mae_{name}"))
    return x.agg(*out)


def banded_mae(places: DataFrame, edges: DataFrame, group: str, value: str, bands: tuple[int, ...] = (0, 1, 5, 20)) -> DataFrame:
    """How well a value is told from elsewhere, by how many neighbours a place has.

    ``edges(keys, nb keys)`` are directed pairs within the radius: a place is in the group of each of its neighbours, so
    groups overlap. Mean absolute error, by band of the number of neighbours, of the mean over all other places, over the
    others of its ``group`` (over all where it stands alone), and over its neighbours (over its group where it has none).
    """
    known = places.where(F.col(value).isNotNull()).select(*KEYS, group, F.col(value).cast("double").alias("v"))
    nb = known.select(F.col("system_id").alias("nb_system_id"), F.col("station_id").alias("nb_station_id"), F.col("v").alias("nb_v"))
    near = edges.join(nb, ["nb_system_id", "nb_station_id"]).groupBy(*KEYS).agg(F.avg("nb_v").alias("near"), F.count(F.lit(1)).alias("n_near"))
    sums = known.groupBy(group).agg(F.sum("v").alias("_s"), F.count(F.lit(1)).alias("_c"))
    whole = sums.agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"))
    x = known.join(sums, known[group].eqNullSafe(sums[group])).drop(sums[group]).join(F.broadcast(whole)).join(near, KEYS, "left")
    all_ = F.try_divide(F.col("_ts") - F.col("v"), F.col("_tc") - 1)
    own = F.when(F.col("_c") > 1, (F.col("_s") - F.col("v")) / (F.col("_c") - 1)).otherwise(all_)
    band = F.lit(0)
    for b in bands:
        band = F.when(F.coalesce("n_near", F.lit(0)) >= b, b).otherwise(band)
    err = lambda c: F.round(F.avg(F.abs(c - F.col("v"))), 6)
    x = x.withColumns({"_all": all_, "_own": own, "_near": F.coalesce("near", own)})
    return x.groupBy(band.alias("least_neighbours")).agg(F.count(F.lit(1)).alias("n"), err(F.col("_all")).alias("mae_all"), err(F.col("_own")).alias("mae_group"), err(F.col("_near")).alias("mae_near"))


def count_mismatch(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """mismatch: groups whose row counts differ, those on one side only included."""
    n = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    both = n(left, "_a").join(n(right, "_b"), by, "full_outer")
    return both.agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).cast("double").alias("mismatch"))


def gap_spread(rows: DataFrame, by: list[str], at: str, prefix: str) -> DataFrame:
    """Median, 95th percentile and greatest of the seconds between a group's successive times; repeated times count once."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (us(F.col(at)) - us(F.lag(at).over(Window.partitionBy(*by).orderBy(at)))) / 1_000_000
    g = rows.select(*by, at).distinct().withColumn("_g", gap)
    return g.agg(F.percentile("_g", 0.5).alias(f"{prefix}_median_s"), F.percentile("_g", 0.95).alias(f"{prefix}_p95_s"), F.coalesce(F.max("_g"), F.lit(0.0)).alias(f"{prefix}_max_s"))


def verdicts(row: DataFrame, limits: dict[str, float]) -> DataFrame:
    """The one row's values as check, value, verdict: FAIL above a limit, PASS at it, below it or without one."""
    long = row.unpivot([], row.columns, "check", "value")
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col("check")]
    return long.withColumn("verdict", F.when(F.coalesce(F.col("value") <= limit, F.lit(True)), "PASS").otherwise("FAIL"))
