"""Outcomes of a count and its flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moorline.config import RENTING, RETURNING


def has_bit(flags: Column, bit: int) -> Column:
    """A negative value is a missing one: all its bits count as unset."""
    return (flags >= 0) & (flags.bitwiseAND(F.lit(bit)) > 0)


def y_bike(bikes: Column, flags: Column) -> Column:
    return ((bikes >= 1) & has_bit(flags, RENTING)).cast("int")


def y_dock(docks: Column, flags: Column) -> Column:
    return ((docks >= 1) & has_bit(flags, RETURNING)).cast("int")
