"""Calendar dimension: day kinds from a holiday list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def calendar(spark: SparkSession, first: str, last: str, holidays: DataFrame) -> DataFrame:
    """One row for each date: day_type, dow_type, is_off, is_day_before_holiday, is_last_business_day.

    day_type, first match wins: newyear (12/29 to 1/3), obon (8/13 to 8/16), holiday, sun,
    sat, bridge (a working day between two off days), weekday. ``holidays(date, name)`` is a
    bounded reference list.
    """
    span = F.sequence(F.date_sub(F.to_date(F.lit(first)), 40), F.date_add(F.to_date(F.lit(last)), 40))
    days = spark.range(1).select(F.explode(span).alias("date"))
    days = days.join(holidays.select("date", F.col("name").alias("holiday_name")).dropDuplicates(["date"]), "date", "left")
    md = F.month("date") * 100 + F.dayofmonth("date")
    dow = F.dayofweek("date")
    fixed = F.when((md >= 1229) | (md <= 103), "newyear").when(md.between(813, 816), "obon").when(F.col("holiday_name").isNotNull(), "holiday").when(dow == 1, "sun").when(dow == 7, "sat")
    days = days.withColumn("_fixed", fixed).withColumn("is_off", F.col("_fixed").isNotNull())
    order = Window.orderBy("date")
    before, after = F.lag("is_off").over(order), F.lead("is_off").over(order)
    month = Window.partitionBy(F.trunc("date", "month"))
    days = days.withColumn("day_type", F.coalesce("_fixed", F.when(before & after, "bridge"), F.lit("weekday")))
    days = days.withColumn("is_day_before_holiday", F.coalesce(after, F.lit(False)))
    days = days.withColumn("is_last_business_day", F.col("date").eqNullSafe(F.max(F.when(~F.col("is_off"), F.col("date"))).over(month)))
    days = days.where(F.col("date").between(first, last))
    return days.select("date", "holiday_name", "day_type", dow_type(F.col("day_type")).alias("dow_type"), "is_off", "is_day_before_holiday", "is_last_business_day")


def dow_type(day_type: Column) -> Column:
    return F.when(day_type == "sat", "sat").when(day_type.isin("weekday", "bridge"), "weekday").otherwise("sun_holiday")


def dow_id(kind: Column) -> Column:
    """Index in sorted order: sat 0, sun_holiday 1, weekday 2."""
    return F.when(kind == "sat", 0).when(kind == "sun_holiday", 1).when(kind == "weekday", 2)


def cyclic(minute: Column) -> tuple[Column, Column]:
    """(sin, cos) of the minute of a day."""
    angle = 2 * F.pi() * (minute % 1440) / 1440
    return F.sin(angle), F.cos(angle)


def target_dow(today: Column, tomorrow: Column, minute: Column, h_min: Column) -> Column:
    """The day kind at the target: tomorrow's once the horizon crosses midnight."""
    return F.when(minute + h_min >= 1440, tomorrow).otherwise(today)
