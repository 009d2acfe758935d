"""Outcome labels and their guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moorline.functions.outcomes import has_bit, y_bike, y_dock

__all__ = ["collision", "has_bit", "y_bike", "y_dock"]


def collision(feature: str, label: str) -> Column:
    """The feature row and the label row are one observation: the outcome would be known already."""
    f, x = F.col(feature), F.col(label)
    return F.coalesce((f["observed_at"] == x["observed_at"]) & (f["fetched_at"] == x["fetched_at"]), F.lit(False))
