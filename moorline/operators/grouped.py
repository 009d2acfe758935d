"""Fits of many groups at once: weighted logistic regression and monotone calibration.

A logistic fit takes Newton steps; a step is one aggregate of the gradient and the Hessian for all
groups together, and only those few sums of a group reach the driver, which solves them. A monotone fit
folds each group's probabilities to bins of equal weight and pools adjacent violators of at most
``bins`` rows a group. Groups may be any columns, or none; a new system needs no new code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

STEPS, TOLERANCE = 50, 1e-9
BINS = 1000
GRID = 1 << 20  #: steps that probabilities are held in before they are cut into bins, which bounds the window's rows


def _matches(by: list[str], table: DataFrame, rows: DataFrame) -> Column:
    on = F.lit(True)
    for c in by:
        on &= rows[c].eqNullSafe(table[f"_{c}"])
    return on


def _beside(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """rows with the few columns of their group's one row of ``table``."""
    named = table.withColumnsRenamed({c: f"_{c}" for c in by})
    joined = rows.join(F.broadcast(named), _matches(by, named, rows), "left") if by else rows.join(F.broadcast(named))
    return joined.drop(*[f"_{c}" for c in by])


def linear(features: list[Column], coefficients: Column) -> Column:
    """Intercept and features by the group's coefficients."""
    out = coefficients[0]
    for i, f in enumerate(features, start=1):
        out = out + coefficients[i] * f
    return out


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logistic(rows: DataFrame, by: list[str], features: list[Column], y: str = "y", w: str = "w", ridge: float = 1e-6) -> DataFrame:
    """by..., coefficients (intercept first) of each group's weighted logistic regression; y may be a rate.

    A step that does not lower the loss is halved. Rows with a null feature, outcome or weight count for nothing.
    """
    spark, d = rows.sparkSession, len(features) + 1
    names = [f"_x{i}" for i in range(1, d)]
    x = rows.select(*by, F.col(y).cast("double").alias("_y"), F.col(w).cast("double").alias("_w"), *[f.cast("double").alias(n) for f, n in zip(features, names, strict=True)])
    x = x.dropna(subset=["_y", "_w", *names])
    schema = StructType([*[StructField(c, x.schema[c].dataType) for c in by], StructField("coefficients", ArrayType(DoubleType()))])
    groups = [tuple(r) for r in x.select(*by).distinct().collect()] if by else [()]
    beta = {g: np.zeros(d) for g in groups}
    good: dict[tuple, tuple[float, np.ndarray, np.ndarray]] = {}  # last accepted loss, coefficients and step
    open_ = set(groups)
    columns = [F.lit(1.0), *[F.col(n) for n in names]]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    for _ in range(STEPS):
        if not open_ or not groups:
            break
        table = spark.createDataFrame([(*g, beta[g].tolist()) for g in groups if g in open_], schema)
        named = table.withColumnsRenamed({c: f"_{c}" for c in by})
        z = x.join(F.broadcast(named), _matches(by, named, x)) if by else x.join(F.broadcast(named))
        z = z.withColumn("_z", linear(columns[1:], F.col("coefficients"))).withColumn("_p", sigmoid(F.col("_z")))
        loss = F.sum(F.col("_w") * (F.greatest(F.col("_z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z"))) - F.col("_y") * F.col("_z")))
        gradient = [F.sum(F.col("_w") * (F.col("_y") - F.col("_p")) * c) for c in columns]
        hessian = [F.sum(F.col("_w") * F.col("_p") * (1 - F.col("_p")) * columns[i] * columns[j]) for i, j in pairs]
        sums = z.groupBy(*by).agg(F.array(loss, *gradient, *hessian).alias("s")).collect()
        for r in sums:
            g, s = tuple(r[c] for c in by), r["s"]
            if s[0] is None:
                open_.discard(g)
                continue
            value = s[0] + 0.5 * ridge * float(beta[g] @ beta[g])
            if g in good and value > good[g][0] + 1e-12 * abs(good[g][0]):
                before, step = good[g][1], good[g][2] / 2
                good[g] = (good[g][0], before, step)
                beta[g] = before + step
                if np.abs(step).max() < TOLERANCE:
                    beta[g] = before
                    open_.discard(g)
                continue
            h = np.zeros((d, d))
            for (i, j), v in zip(pairs, s[d + 1 :], strict=True):
                h[i, j] = h[j, i] = v
            step = np.linalg.solve(h + ridge * np.eye(d), np.array(s[1 : d + 1]) - ridge * beta[g])
            good[g] = (value, beta[g].copy(), step)
            beta[g] = beta[g] + step
            if np.abs(step).max() < TOLERANCE:
                open_.discard(g)
    return spark.createDataFrame([(*g, beta[g].tolist()) for g in groups], schema)


def predicted(rows: DataFrame, coefficients: DataFrame, by: list[str], features: list[Column], name: str) -> DataFrame:
    """rows with the probability that their group's coefficients give."""
    return _beside(rows, coefficients, by).withColumn(name, sigmoid(linear(features, F.col("coefficients")))).drop("coefficients")


def bins(rows: DataFrame, by: list[str], p: str, y: str, w: str, count: int = BINS) -> DataFrame:
    """by..., p, y, w of at most ``count`` bins of equal weight in the order of p; equal values (of ``GRID`` steps) stay together."""
    step = F.round(F.col(p) * GRID).cast("long").alias("_v")
    values = rows.groupBy(*by, step).agg(F.sum(w).alias("_w"), F.sum(F.col(p) * F.col(w)).alias("_p"), F.sum(F.col(y) * F.col(w)).alias("_y"))
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("_w").over(own.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("_w").over(own)
    values = values.withColumn("_b", F.least(F.floor(F.coalesce(before, F.lit(0.0)) * count / whole), F.lit(count - 1)))
    return values.groupBy(*by, "_b").agg((F.sum("_p") / F.sum("_w")).alias("p"), (F.sum("_y") / F.sum("_w")).alias("y"), F.sum("_w").alias("w"))


def pooled(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The nearest rising sequence by weighted squares: adjacent violators pooled."""
    blocks: list[tuple[float, float, int]] = []
    for value, weight in zip(y.tolist(), w.tolist(), strict=True):
        n = 1
        while blocks and blocks[-1][0] > value:
            v, u, k = blocks.pop()
            value, weight, n = (v * u + value * weight) / (u + weight), u + weight, k + n
        blocks.append((value, weight, n))
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def monotone(rows: DataFrame, by: list[str], p: str, y: str, w: str, count: int = BINS) -> DataFrame:
    """by..., knots_x and knots_y of each group's monotone fit."""
    binned = bins(rows, by, p, y, w, count)
    own = F.array_sort(F.collect_list(F.struct("p", "y", "w"))).alias("b")
    table = binned.groupBy(*by).agg(own) if by else binned.agg(own)
    schema = StructType([*[StructField(c, table.schema[c].dataType) for c in by], StructField("knots_x", ArrayType(DoubleType())), StructField("knots_y", ArrayType(DoubleType()))])

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            xs, ys = [], []
            for b in frame["b"]:
                x, y, w = (np.array([r[c] for r in b], dtype=float) for c in "pyw")
                xs.append(x.tolist())
                ys.append(pooled(y, w).tolist())
            yield pd.DataFrame({**{c: frame[c] for c in by}, "knots_x": xs, "knots_y": ys})

    return table.mapInPandas(fit, schema)


@dataclass
class Calibration:
    """A logistic and a monotone fit for each group."""

    by: list[str]
    features: list[Column]
    coefficients: DataFrame
    knots: list[tuple]  #: group values, knots_x, knots_y


def calibrate(rows: DataFrame, by: list[str], features: list[Column], y: str = "y", w: str = "w") -> Calibration:
    """Logistic regression of each group, then a monotone fit of its output."""
    table = logistic(rows, by, features, y, w)
    scored = _beside(rows, table, by).withColumn("_q", sigmoid(linear(features, F.col("coefficients")))).where("_q is not null")
    knots = [tuple(r) for r in monotone(scored, by, "_q", y, w).select(*by, "knots_x", "knots_y").collect()]
    return Calibration(by, features, table, knots)


def calibrated(rows: DataFrame, fit: Calibration, name: str) -> DataFrame:
    """rows with the group's calibrated probability, read off the knots by linear interpolation; null where a feature is, or the group is unknown."""
    n = len(fit.by)
    xs = [np.array(k[n]) for k in fit.knots]
    ys = [np.array(k[n + 1]) for k in fit.knots]
    schema = StructType([*[StructField(c, rows.schema[c].dataType) for c in fit.by], StructField("_g", DoubleType())])
    numbers = rows.sparkSession.createDataFrame([(*k[:n], float(i)) for i, k in enumerate(fit.knots)], schema)

    @F.pandas_udf("double")
    def read(p: pd.Series, group: pd.Series) -> pd.Series:
        out = np.full(len(p), np.nan)
        for g in group.dropna().unique():
            at = ((group == g) & p.notna()).to_numpy()
            out[at] = np.interp(p.to_numpy()[at], xs[int(g)], ys[int(g)])
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    x = _beside(_beside(rows, fit.coefficients, fit.by), numbers, fit.by)
    x = x.withColumn(name, read(sigmoid(linear(fit.features, F.col("coefficients"))), F.col("_g")))
    return x.drop("coefficients", "_g")
