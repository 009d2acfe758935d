"""Status and information feeds: validated scans of nested JSON, and their normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moorline.config import INSTALLED, RENTING, RETURNING

STATION = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("num_bikes_available", T.LongType()),
        T.StructField("num_docks_available", T.LongType()),
        T.StructField("is_installed", T.BooleanType()),
        T.StructField("is_renting", T.BooleanType()),
        T.StructField("is_returning", T.BooleanType()),
        T.StructField("last_reported", T.LongType()),
    ]
)
STATUS = T.StructType(
    [
        T.StructField("last_updated", T.LongType()),
        T.StructField("ttl", T.LongType()),
        T.StructField("version", T.StringType()),
        T.StructField("data", T.StructType([T.StructField("stations", T.ArrayType(STATION))])),
    ]
)
INFORMATION = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("capacity", T.DoubleType()),
        T.StructField("vehicle_capacity", T.StringType()),
    ]
)
#: Bounds of epochs, counts and coordinates that a feed may hold.
EPOCH, COUNT, LAT, LON = (1577836800, 4102444800), 32767, (20.0, 46.0), (122.0, 154.0)
MOST_ISSUES = 10


def scan(spark: SparkSession, path: str, system_id: str) -> DataFrame:
    """Feed files as rows: system_id, fetched_at (file time), raw text."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("fetched_at"))
    return files.withColumn("system_id", F.lit(system_id))


def validate(feeds: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the parsed ``feed`` and ``issues``: why it is refused, at most ten reasons; empty for a good feed."""
    f = F.from_json(raw, STATUS)
    df = feeds.withColumn("feed", f)
    s = F.col("feed.data.stations")
    out = lambda c: (c < -COUNT) | (c > COUNT)
    bad = F.flatten(
        F.transform(
            F.coalesce(s, F.array().cast(T.ArrayType(STATION))),
            lambda x, i: F.array_compact(
                F.array(
                    F.when(F.coalesce(x["station_id"], F.lit("")) == "", F.concat(F.lit("empty id at "), i.cast("string"))),
                    F.when(x["num_bikes_available"].isNull() | out(x["num_bikes_available"]), F.concat(F.lit("bad bikes at "), i.cast("string"))),
                    F.when(x["num_docks_available"].isNull() | out(x["num_docks_available"]), F.concat(F.lit("bad docks at "), i.cast("string"))),
                )
            ),
        )
    )
    top = F.array_compact(
        F.array(
            F.when(F.col("feed").isNull() | F.col("feed.last_updated").isNull(), "no last_updated"),
            F.when(~F.col("feed.last_updated").between(*EPOCH), "last_updated out of range"),
            F.when(s.isNull(), "no stations"),
        )
    )
    return df.withColumn("issues", F.slice(F.concat(top, bad), 1, MOST_ISSUES))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good feeds, quarantined feeds)."""
    return validated.where(F.size("issues") == 0), validated.where(F.size("issues") > 0)


def clamp(x: Column, low: int = 0, high: int = COUNT) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def explode_status(good: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each listed station, with its place in the feed."""
    return good.select(*keys, F.col("feed.last_updated").alias("last_updated"), F.posexplode("feed.data.stations").alias("pos", "s"))


def normalise(exploded: DataFrame, feed_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, warnings). The first entry of an id wins; negative counts become 0; flags are a bit sum; the age is clamped, absent is 0."""
    s = F.col("s")
    rows = exploded.select(
        *feed_keys,
        "pos",
        F.col("s.station_id").alias("station_id"),
        F.greatest(s["num_bikes_available"], F.lit(0)).cast("int").alias("bikes"),
        F.greatest(s["num_docks_available"], F.lit(0)).cast("int").alias("docks"),
        (F.coalesce(s["is_installed"], F.lit(False)).cast("int") * INSTALLED + F.coalesce(s["is_renting"], F.lit(False)).cast("int") * RENTING + F.coalesce(s["is_returning"], F.lit(False)).cast("int") * RETURNING).alias("flags"),
        F.coalesce(clamp(F.col("last_updated") - s["last_reported"]), F.lit(0)).cast("int").alias("reported_age_s"),
        (F.least(s["num_bikes_available"], s["num_docks_available"]) < 0).alias("_negative"),
        s["last_reported"].isNull().alias("_missing"),
        F.coalesce(~(F.col("last_updated") - s["last_reported"]).between(0, COUNT), F.lit(False)).alias("_clamped"),
    )
    order = Window.partitionBy(*feed_keys, "station_id").orderBy("pos")
    values = F.struct("bikes", "docks", "flags", "reported_age_s")
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_same", values == F.first(values).over(order))
    first = F.col("_n") == 1
    warnings = rows.groupBy(*feed_keys).agg(
        F.count_if(~first & F.col("_same")).alias("exact_duplicates"),
        F.count_if(~first & ~F.col("_same")).alias("conflicting_duplicates"),
        F.count_if(first & F.col("_missing")).alias("missing_reported"),
        F.count_if(first & F.col("_clamped")).alias("clamped_age"),
        F.count_if(first & F.col("_negative")).alias("clamped_negative"),
    )
    return rows.where(first).drop("_n", "_same", "_negative", "_missing", "_clamped"), warnings


def capacity_of(capacity: Column, vehicle_capacity: Column) -> Column:
    """The capacity, else a numeric vehicle capacity, cut to an integer in range; unparsable is null."""
    n = F.coalesce(capacity, vehicle_capacity.try_cast("double"))
    return F.when(~F.isnan(n), clamp(F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)))).cast("int")


def geo_suspect(lat: Column, lon: Column) -> Column:
    return F.coalesce(~(lat.between(*LAT) & lon.between(*LON)), F.lit(True))


def normalise_information(rows: DataFrame, feed_keys: list[str]) -> DataFrame:
    """Station attributes, first entry of an id, from rows(feed keys, pos, station_id, name, lat, lon, capacity, vehicle_capacity)."""
    order = Window.partitionBy(*feed_keys, "station_id").orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return rows.select(*feed_keys, "station_id", "name", "lat", "lon", capacity_of(F.col("capacity"), F.col("vehicle_capacity")).alias("capacity"), geo_suspect(F.col("lat"), F.col("lon")).alias("geo_suspect"))


def json_number(text: Column, path: str) -> Column:
    """A field of JSON text as a number; null unless it is one."""
    v = F.get_json_object(text, path)
    return F.when(F.regexp_like(v, F.lit(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), v).cast("double")


def json_boolean(text: Column, path: str) -> Column:
    v = F.get_json_object(text, path)
    return F.when(v == "true", True).when(v == "false", False)
