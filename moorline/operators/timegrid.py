"""Regular time grids and local calendar arithmetic (fixed offset; timestamps without zone are UTC)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def minutes(n: int | Column) -> Column:
    return F.make_dt_interval(mins=F.lit(n) if isinstance(n, int) else n)


def on_grid(at: str, step_min: int) -> str:
    """at, if it is a grid time of its day; else an error: off-grid times would silently meet no state."""
    t = datetime.fromisoformat(at)
    if (t.hour * 60 + t.minute) % step_min or t.second or t.microsecond:
        raise ValueError(f"{at} is off the grid of {step_min} minutes")
    return at


def entity_grid(entities: DataFrame, start: str, end: str, step_min: int, t: str = "t") -> DataFrame:
    """Every entity at every grid time from start to end, end excluded. No join: each row grows its own times."""
    times = F.sequence(F.to_timestamp_ntz(F.lit(on_grid(start, step_min))), F.to_timestamp_ntz(F.lit(on_grid(end, step_min))) - minutes(step_min), minutes(step_min))
    return entities.withColumn(t, F.explode(times))


def grid(spark: SparkSession, start: str, end: str, step_min: int, back_min: int = 0, ahead_min: int = 0) -> DataFrame:
    """Grid times of a window with margins on both sides."""
    first, last = F.to_timestamp_ntz(F.lit(on_grid(start, step_min))) - minutes(back_min), F.to_timestamp_ntz(F.lit(on_grid(end, step_min))) + minutes(ahead_min) - minutes(step_min)
    return spark.range(1).select(F.explode(F.sequence(first, last, minutes(step_min))).alias("t"))


def floor_to(ts: Column, step_min: int) -> Column:
    """The grid time at or before ts (days start on the grid)."""
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    return day + minutes(F.floor((F.hour(ts) * 60 + F.minute(ts)) / step_min).cast("int") * step_min)


def local(ts: Column, offset_h: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(offset_h))


def local_date(ts: Column, offset_h: int) -> Column:
    return F.to_date(local(ts, offset_h))


def minute_of_day(ts: Column, offset_h: int) -> Column:
    at = local(ts, offset_h)
    return F.hour(at) * 60 + F.minute(at)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, as an integer."""
    return F.unix_micros(ts.cast("timestamp"))
