"""Counts, probabilities and their scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(count: Column) -> Column:
    """Index of a count's bucket: at most 0, 1, 2, 3-5, 6-10, 11 or more."""
    return F.when(count <= 0, 0).when(count == 1, 1).when(count == 2, 2).when(count <= 5, 3).when(count <= 10, 4).otherwise(5)


def persistence(count: Column) -> Column:
    return (count >= 1).cast("double")


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip)))
    return F.log(q / (1 - q))


def x1000(p: Column) -> Column:
    """A probability in thousandths, ties to even, within 0..1000."""
    return F.least(F.greatest(F.rint(p * 1000), F.lit(0.0)), F.lit(1000.0)).cast("short")


def brier(p: Column, y: Column, w: Column) -> Column:
    return F.sum(w * F.pow(p - y, 2)) / F.sum(w)


def brier_x1000(p1000: Column, y: Column) -> Column:
    """The plain mean for probabilities in thousandths, summed in integers: no order of the rows moves its last digit."""
    e = (p1000 - 1000 * y).cast("long")
    return F.try_divide(F.sum(e * e), F.count(e) * 1_000_000)


def log_loss(p: Column, y: Column, w: Column, clip: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -F.sum(w * (y * F.log(q) + (1 - y) * F.log(1 - q))) / F.sum(w)


def positives(y: Column, w: Column) -> Column:
    return F.sum(w * y) / F.sum(w)


def skill(value: Column, reference: Column) -> Column:
    return F.when(reference > 0, 1 - value / reference)
