"""Probability quality: scores, reliability, slices, ablations and borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorline.functions.scores import brier, brier_x1000, log_loss, positives, skill  # noqa: F401

KEYS = ["system_id", "station_id"]
BANDS = ((0, 5, "night"), (6, 9, "morning"), (10, 15, "day"), (16, 19, "evening"), (20, 23, "late"))


def reliability(rows: DataFrame, by: list[str], bins: int = 20) -> DataFrame:
    """Equal-width bins of p1000 (an edge belongs to the upper bin); empty bins are left out."""
    b = F.least(F.floor(F.col("p1000") * bins / 1000), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sum_w"), (F.sum(F.col("w") * F.col("p1000")) / F.sum("w") / 1000).alias("mean_p"), positives(F.col("y"), F.col("w")).alias("observed"))


def reliability_quantile(rows: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """Equal-weight bins: rows collapse to their distinct p1000 (1001 values at most), cumulative weight gives the edges, equal values share a bin."""
    values = rows.groupBy(*by, "p1000").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy("p1000") if by else Window.orderBy("p1000")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    values = values.withColumn("_c", F.sum("w").over(order)).withColumn("_t", F.sum("w").over(whole))
    # the edge of share k is the least value with cumulative weight >= k/bins; a value's bin counts the edges below it
    reached = F.floor(F.col("_c") * bins / F.col("_t"))
    before = F.coalesce(F.max(F.least(reached, F.lit(bins - 1))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("bin", before.cast("int"))
    return values.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum("w").alias("sum_w"), (F.sum(F.col("w") * F.col("p1000")) / F.sum("w") / 1000).alias("mean_p"), (F.sum("wy") / F.sum("w")).alias("observed"))


def ece(bins: DataFrame, by: list[str]) -> DataFrame:
    return bins.groupBy(*by).agg((F.sum(F.col("sum_w") * F.abs(F.col("observed") - F.col("mean_p"))) / F.sum("sum_w")).alias("ece"))


def decision(rows: DataFrame, by: list[str], high: int = 900, bands: tuple[int, int] = (850, 600)) -> DataFrame:
    """Precision and coverage at p >= high/1000, and share and realised rate of three bands (null when empty)."""
    w, wy, p = F.col("w"), F.col("w") * F.col("y"), F.col("p1000")
    part = {"high": p >= high, "sure": p >= bands[0], "likely": (p < bands[0]) & (p >= bands[1]), "unsure": p < bands[1]}
    cols = []
    for name, c in part.items():
        cols.append((F.coalesce(F.sum(F.when(c, w)), F.lit(0)) / F.sum(w)).alias(f"share_{name}"))
        cols.append((F.sum(F.when(c, wy)) / F.sum(F.when(c, w))).alias(f"rate_{name}"))
    return rows.groupBy(*by).agg(*cols)


def band(minute: Column) -> Column:
    hour = F.floor(minute / 60)
    out = F.when(F.lit(False), F.lit(""))
    for low, high, name in BANDS:
        out = out.when(hour.between(low, high), name)
    return out


def slices(rows: DataFrame, few_h: tuple[int, ...]) -> DataFrame:
    """Overall, by horizon, by bucket at a few horizons, by day kind and by arrival band: one pass of grouping sets."""
    rows = rows.withColumn("bucket_h", F.when(F.col("h_min").isin(*few_h), F.col("bucket")))
    rows = rows.withColumn("band", band(F.col("arrival_minute")))
    sets = [[], [F.col("h_min")], [F.col("h_min"), F.col("bucket_h")], [F.col("dow_type")], [F.col("band")]]
    keys = [F.col(c) for c in ("h_min", "bucket_h", "dow_type", "band")]
    p, y, w = F.col("p1000") / 1000, F.col("y"), F.col("w")
    out = rows.groupingSets(sets, *keys).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.round(brier(p, y, w), 9).alias("brier"), F.round(positives(y, w), 9).alias("positives"))
    level = F.when(F.col("level") == 15, "overall").when(F.col("level") == 7, "horizon").when(F.col("level") == 3, "bucket").when(F.col("level") == 13, "dow_type").otherwise("band")
    out = out.withColumn("slice", level).where((F.col("slice") != "bucket") | F.col("bucket_h").isNotNull())
    return out.select("slice", "h_min", F.col("bucket_h").alias("bucket"), "dow_type", "band", "n", "brier", "positives")


def unpivot_models(rows: DataFrame, models: list[str], ids: list[str]) -> DataFrame:
    return rows.unpivot(ids, models, "model", "p")


def port_sums(rows: DataFrame, full: str, ablated: str) -> DataFrame:
    """Each station's summed squared errors with and without a component."""
    e = lambda c: F.sum(F.col("w") * F.pow(F.col(c) / 1000 - F.col("y"), 2))
    return rows.groupBy("system_id", "station_id").agg(e(full).alias("full"), e(ablated).alias("ablated"))


REPS = 1000


def poisson(u: Column) -> Column:
    """The Poisson(1) count whose cumulative share first exceeds u."""
    import math

    shares, out = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)], F.lit(9)
    for k in reversed(range(9)):
        out = F.when(u < shares[k], k).otherwise(out)
    return out


def bootstrap(ports: DataFrame, reps: int = REPS, by: tuple[str, ...] = ("system_id",)) -> DataFrame:
    """Relative loss of the ablation by ``by``, with a 95 % interval: stations are drawn again with Poisson(1) weights from an md5 of station and repetition (the same on any engine)."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", "system_id", "station_id", F.col("rep").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = ports.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("k_", poisson((draw + 0.5) / float(1 << 32)))
    loss = lambda w: F.try_divide(F.sum(w * (F.col("ablated") - F.col("full"))), F.sum(w * F.col("full")))  # a draw of no station says nothing
    rep = drawn.groupBy(*by, "rep").agg(loss(F.col("k_")).alias("g"))
    spread = rep.groupBy(*by).agg(F.percentile("g", 0.025).alias("low"), F.percentile("g", 0.975).alias("high"), F.count(F.lit(1)).alias("reps"))
    whole = ports.groupBy(*by).agg(loss(F.lit(1)).alias("gain"))
    return whole.join(spread, list(by)).select(*by, "gain", "low", "high", "reps")


def border(cells: DataFrame) -> DataFrame:
    """Routed cells that have a neighbour (next horizon or bucket) that is not routed; outside the table counts as routed."""
    order = Window.partitionBy("system_id", "target", "bucket").orderBy("h_min")
    across = Window.partitionBy("system_id", "target", "h_min").orderBy("bucket")
    off = F.lit(False)
    for w in (order, across):
        off = off | ~F.coalesce(F.lag("to_forest").over(w), F.lit(True)) | ~F.coalesce(F.lead("to_forest").over(w), F.lit(True))
    return cells.withColumn("at_border", F.col("to_forest") & off)


def gap_quantiles(rows: DataFrame, by: list[str]) -> DataFrame:
    g = F.abs(F.col("p1000") - F.col("q1000"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile(g, 0.5).alias("p50"), F.percentile(g, 0.9).alias("p90"), F.max(g).alias("largest"))


def top_share(importance: DataFrame, k: int) -> DataFrame:
    """Share of the k most important features."""
    rank = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))
    return importance.withColumn("_r", rank).agg((F.sum(F.when(F.col("_r") <= k, F.col("importance"))) / F.sum("importance")).alias("top_share"))


def to_served(log: DataFrame) -> DataFrame:
    """Forecast log arrays as rows: one for each horizon."""
    z = F.arrays_zip("horizons_min", "p_bike_x1000", "p_dock_x1000")
    rows = log.select("model_version", *KEYS, "t", F.explode(z).alias("z"))
    return rows.select("model_version", *KEYS, "t", F.col("z.horizons_min").alias("h_min"), F.col("z.p_bike_x1000").alias("p_bike"), F.col("z.p_dock_x1000").alias("p_dock"))


def ablation_by_days(rows: DataFrame, k: str, full: str, ablated: str, reps: int = REPS) -> DataFrame:
    """By contributing days k: relative loss without the component with its interval, and how many (system, horizon) pairs are not worse with the component."""
    e = lambda c: F.sum(F.col("w") * F.pow(F.col(c) / 1000 - F.col("y"), 2))
    pairs = rows.groupBy(F.col(k).alias("k"), "system_id", "h_min").agg(e(full).alias("full"), e(ablated).alias("ablated"))
    counts = pairs.groupBy("k").agg(F.count_if(F.col("full") <= F.col("ablated")).alias("n_not_worse"), F.count(F.lit(1)).alias("n_pairs"))
    ports = rows.groupBy(F.col(k).alias("k"), "system_id", "station_id").agg(e(full).alias("full"), e(ablated).alias("ablated"))
    return bootstrap(ports, reps, ("k",)).join(counts, "k")


def helped(least_pairs: int = 3) -> Column:
    return (F.col("gain") > 0) & (F.col("low") > 0) & (F.col("n_not_worse") >= least_pairs)


def choose_floor(measured: DataFrame, helped: Column) -> DataFrame:
    """The smallest k from which on every k was helped; null when the largest was not."""
    x = measured.withColumn("helped", helped)
    last_bad = x.agg(F.max(F.when(~F.col("helped"), F.col("k"))).alias("bad"), F.max("k").alias("top"))
    return x.join(last_bad).agg(F.min(F.when(F.col("bad").isNull() | (F.col("k") > F.col("bad")), F.col("k"))).alias("floor"))


def tree_budget(candidates: DataFrame, within: float = 0.01) -> DataFrame:
    """The fewest trees whose improvement is within a point of the largest candidate's: candidates(trees, improvement)."""
    top = candidates.agg(F.max_by("improvement", "trees").alias("reference"))
    return candidates.join(top).where(F.col("improvement") >= F.col("reference") - within).agg(F.min("trees").alias("trees"), F.max("reference").alias("reference"))
