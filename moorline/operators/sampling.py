"""Deterministic sampling, weights and time splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*keys: Column) -> Column:
    """An integer in [0, 2**32) from an md5 of the keys: the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys).cast("binary")), 1, 8), 16, 10).cast("long")


def accepted(rate: float, *keys: Column) -> Column:
    return uniform(*keys) < int(rate * (1 << 32))


def with_weight(df: DataFrame, rate: float) -> DataFrame:
    """Inverse-probability weight of a uniform sample."""
    return df.withColumn("weight", F.lit(1.0 / rate))


LOW = 0xFFFFFFFF


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def wrapped_sum(a: Column, b: Column) -> Column:
    """a + b modulo 2**64 for longs, in halves of 32 bits: no step passes a long's range."""
    low = _low(a) + _low(b)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(_low(low))


def wrapped_product(a: Column, by: int) -> Column:
    """a * by modulo 2**64, ``by`` a constant below 2**64."""

    def scaled(x: Column, k: int) -> Column:
        return wrapped_sum(F.shiftleft(x * F.lit(k >> 16), 16), x * F.lit(k & 0xFFFF))

    low, high = _low(a), F.shiftrightunsigned(a, 32)
    cross = _low(scaled(low, by >> 32)) + _low(scaled(high, by & LOW))
    return wrapped_sum(scaled(low, by & LOW), F.shiftleft(cross, 32))


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


# Fixed values of the published splitmix64 generator: its increment, shifts and multipliers.
GAMMA, ROUNDS, LAST = 0x9E3779B97F4A7C15, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)), 31


def with_uniforms(df: DataFrame, states: list[Column], name: str) -> DataFrame:
    """df with ``name``, an array of numbers in [0, 1): the top 53 bits of splitmix64 of each state (longs taken as 64 bits).

    Every step is a column of its own, so each is computed once. A filter on the result may undo that when Spark
    pushes it below: write the table first.
    """
    steps = [f"_z{i}" for i in range(len(states))]
    df = df.withColumns({z: wrapped_sum(s.cast("long"), _signed(GAMMA)) for z, s in zip(steps, states, strict=True)})
    for shift, by in ROUNDS:
        df = df.withColumns({z: F.col(z).bitwiseXOR(F.shiftrightunsigned(F.col(z), shift)) for z in steps})
        df = df.withColumns({z: wrapped_product(F.col(z), by) for z in steps})
    top = lambda z: F.shiftrightunsigned(F.col(z).bitwiseXOR(F.shiftrightunsigned(F.col(z), LAST)), 11) / float(1 << 53)
    return df.withColumn(name, F.array(*[top(z) for z in steps])).drop(*steps)


def entity_seed(day: Column, *keys: Column) -> Column:
    """64 bits of an md5 of the day and the entity's keys, whatever the rows' order or partitions."""
    digest = F.md5(F.concat_ws("|", F.date_format(day, "yyyy-MM-dd"), *keys).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def with_draws(df: DataFrame, day: Column, keys: list[Column], grid_index: Column, horizons: int, rate: float, name: str = "_draws") -> DataFrame:
    """df with an array of flags: which of a point's horizons are drawn.

    Each (point, horizon) pair is drawn by itself, by the number of (seed of day and entity) + grid_index * horizons +
    horizon's index: pairs are independent, every pair has the same weight, and a day made again has the same pairs.
    """
    df = df.withColumns({"_seed": entity_seed(day, *keys), "_first": grid_index.cast("long") * horizons})
    df = with_uniforms(df, [wrapped_sum(F.col("_seed"), F.col("_first") + i) for i in range(horizons)], name)
    return df.withColumn(name, F.transform(name, lambda u: u < rate)).drop("_seed", "_first")


def window_days(available: DataFrame, end: str, days: int) -> DataFrame:
    """The days of a window that ends at ``end``: ``present`` tells which partitions exist. Missing days are told; reading a window whose last day is missing is an error."""
    wanted = available.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(F.lit(end)), days - 1), F.to_date(F.lit(end)))).alias("day"))
    x = wanted.join(available.select("day", F.lit(True).alias("present")).distinct(), "day", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    missing = (F.col("day") == F.to_date(F.lit(end))) & ~F.col("present")
    return x.withColumn("present", F.when(missing, F.raise_error(F.lit(f"the window's last day {end} is missing")).cast("boolean")).otherwise(F.col("present")))


def split_days(days: DataFrame, evaluate: int, purge: int = 1, baseline: int = 7) -> DataFrame:
    """Newest ``evaluate`` days are for evaluation, the ``purge`` days before them are left out, the rest is for fitting; ``is_baseline`` marks the newest ``baseline`` fit days.

    Reading a split that leaves no day for fitting is an error.
    """
    if evaluate < 1 or purge < 0:
        raise ValueError(f"{evaluate} evaluation and {purge} purged days make no split")
    rank = F.row_number().over(Window.orderBy(F.col("day").desc()))
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    x = days.select("day").distinct().withColumns({"_r": rank, "_n": total})
    few = F.raise_error(F.concat(F.col("_n").cast("string"), F.lit(f" days are too few for {evaluate} evaluation and {purge} purged days"))).cast("string")
    part = F.when(F.col("_n") <= evaluate + purge, few).when(F.col("_r") <= evaluate, "evaluate").when(F.col("_r") <= evaluate + purge, "purge").otherwise("fit")
    return x.select("day", part.alias("part"), F.col("_r").between(evaluate + purge + 1, evaluate + purge + baseline).alias("is_baseline"))
