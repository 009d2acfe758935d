"""Column functions: built from Spark's own, so they stay inside code generation and work in any select, filter or aggregate."""

from moorline.functions.geo import cell, haversine
from moorline.functions.outcomes import has_bit, y_bike, y_dock
from moorline.functions.scores import brier, bucket, log_loss, logit, persistence, positives, skill, x1000

__all__ = ["brier", "bucket", "cell", "has_bit", "haversine", "log_loss", "logit", "persistence", "positives", "skill", "x1000", "y_bike", "y_dock"]
