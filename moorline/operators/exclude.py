"""Exclusion waterfalls: each dropped point or pair is counted under exactly one reason, in priority order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.config import RENTING, RETURNING
from moorline.operators.labels import collision, has_bit

BASE = ("phantom", "no_asof_at_t", "stale_at_t", "unobserved_at_t", "suspended_at_t")
TARGET = ("no_asof_at_target", "stale_at_target", "unobserved_at_target", "collision")


def _age_us(t: Column, observed: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) - F.unix_micros(observed.cast("timestamp"))


def base_reason(seen: str, t: str, staleness_s: int, phantom: Column | None = None) -> Column:
    """Why a point cannot be a base, or null. A suspended point (flags missing, or not both renting and returning) is no base."""
    s = F.col(seen)
    return (
        F.when(F.lit(False) if phantom is None else phantom, "phantom")
        .when(s.isNull(), "no_asof_at_t")
        .when(_age_us(F.col(t), s["observed_at"]) > staleness_s * 1_000_000, "stale_at_t")
        .when((s["bikes"] == -1) | (s["docks"] == -1), "unobserved_at_t")
        .when(~(has_bit(s["flags"], RENTING) & has_bit(s["flags"], RETURNING)), "suspended_at_t")
    )


def target_reason(truth: str, t: str, staleness_s: int, seen: str) -> Column:
    """Why a pair has no usable outcome, or null. Suspension at the target is an outcome (label 0), not a reason."""
    s = F.col(truth)
    return (
        F.when(s.isNull(), "no_asof_at_target")
        .when(_age_us(F.col(t), s["observed_at"]) > staleness_s * 1_000_000, "stale_at_target")
        .when((s["bikes"] == -1) | (s["docks"] == -1), "unobserved_at_target")
        .when(collision(seen, truth), "collision")
    )


def account(points: DataFrame, pairs: DataFrame, horizons: int, by: list[str]) -> DataFrame:
    """Pairs by reason: base reasons count once for each horizon; ``kept`` is the rest. Counts add up to all pairs."""
    base = points.where(F.col("base_reason").isNotNull()).groupBy(*by, F.col("base_reason").alias("reason")).agg((F.count(F.lit(1)) * horizons).alias("n_pairs"))
    target = pairs.groupBy(*by, F.coalesce("target_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n_pairs"))
    return base.unionByName(target)
