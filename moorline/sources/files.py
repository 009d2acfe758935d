"""Other sources: holiday lists and weather archives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moorline.functions.geo import cell


def _decoded(encoding: str):  # noqa: ANN202
    """Text of a binary column: the JVM reader takes only a few encodings."""

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda x: bytes(x).decode(encoding))

    return run


def holidays_csv(spark: SparkSession, path: str, least: int = 100, known: list[str] | None = None) -> DataFrame:
    """date, name from a Shift_JIS list of YYYY/M/D,name rows. Too few rows, doubled dates or unknown names are errors."""
    lines = F.split(_decoded("shift_jis")("content"), r"\r?\n")
    rows = spark.read.format("binaryFile").load(path).select(F.posexplode(lines).alias("pos", "line")).where("pos > 0 and trim(line) <> ''")
    rows = rows.select(F.from_csv("line", F.lit("date string, name string")).alias("r")).select(F.to_date("r.date", "yyyy/M/d").alias("date"), F.trim("r.name").alias("name"))
    return check_holidays(rows, least, known)


def check_holidays(rows: DataFrame, least: int, known: list[str] | None = None) -> DataFrame:
    wrong = F.lit(False) if known is None else ~F.col("name").isin(known)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("d"), F.count_if(wrong | F.col("date").isNull()).alias("w")).first()
    if seen.n < least or seen.d != seen.n or seen.w:
        raise ValueError(f"{seen.n} rows, {seen.d} dates, {seen.w} of unknown name or date")
    return rows


def content_digest(rows: DataFrame) -> DataFrame:
    """sha256 of the sorted date=name lines of a bounded reference list."""
    line = F.concat_ws("=", F.date_format("date", "yyyy-MM-dd"), "name")
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n_rows"))


PLACE = T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("hourly", T.StructType([T.StructField("time", T.ArrayType(T.StringType())), *[T.StructField(v, T.ArrayType(T.DoubleType())) for v in ("precipitation", "temperature_2m", "wind_speed_10m")]]))])


def weather_batch(raw: DataFrame, issued_hour: str, lat_step: float, lon_step: float, leads: int, offset_h: int) -> DataFrame:
    """Cells of weather JSON (one place or a list): ``leads`` values from the local issue hour on; a file that ends sooner is an error."""
    text = F.trim("raw")
    places = F.when(text.startswith("["), F.from_json(text, T.ArrayType(PLACE))).otherwise(F.array(F.from_json(text, PLACE)))
    local = F.date_format(F.col(issued_hour) + F.make_dt_interval(hours=F.lit(offset_h)), "yyyy-MM-dd'T'HH:mm")
    rows = raw.select(F.col(issued_hour).alias("issued_hour"), local.alias("_local"), F.explode(places).alias("p"))
    rows = rows.withColumn("_at", F.array_position("p.hourly.time", F.col("_local")).cast("int"))
    short = (F.col("_at") == 0) | (F.col("_at") + leads - 1 > F.size("p.hourly.time"))
    cut = lambda v, name: F.when(short, F.raise_error(F.lit("weather file too short")).cast("array<double>")).otherwise(F.slice(F.col(f"p.hourly.{v}"), F.col("_at"), leads)).alias(name)
    return rows.select("issued_hour", cell(F.col("p.latitude"), lat_step).alias("lat_idx"), cell(F.col("p.longitude"), lon_step).alias("lon_idx"), cut("precipitation", "precip_mm"), cut("temperature_2m", "temp_c"), cut("wind_speed_10m", "wind_kmh"))


def write_weather(places: DataFrame, path: str) -> None:
    """A gzip JSON file for each issue and tile below ``path``, a list of the tile's places: places(issued_hour, tile, place JSON). What is gathered into one row is bounded by the cells of a tile, not of the issue."""
    one = places.groupBy("issued_hour", "tile").agg(F.concat(F.lit("["), F.array_join(F.collect_list("place"), ","), F.lit("]")).alias("value"))
    write_tiles(in_order(one), path)


def in_order(tiles: DataFrame) -> DataFrame:
    """tiles(issued_hour, tile, ...) of a task in the order of their files, which are named by ``issue`` and tile. Rows that get their text after it are written without a sort of texts."""
    name = lambda c: F.coalesce(c, F.lit(""))  # noqa: E731  # never null, or the writer sorts again
    rows = tiles.withColumns({"issue": name(F.date_format("issued_hour", "yyyyMMddHH")), "tile": name(F.col("tile"))})
    return rows.sortWithinPartitions("issue", "tile")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """The gzip files of tiles(issue, tile, value) that ``in_order`` sorted: value is the list of the tile's places."""
    tiles.select("value", "issue", "tile").write.partitionBy("issue", "tile").text(path, compression="gzip")


def scan_weather(spark: SparkSession, path: str) -> DataFrame:
    """issued_hour and raw text of the gzip files below ``path``, named by their issue; an issue may have several."""
    rows = spark.read.option("basePath", path).schema("value string, issue string").text(f"{path}/issue=*", wholetext=True)
    return rows.select(F.to_timestamp_ntz(F.col("issue"), F.lit("yyyyMMddHH")).alias("issued_hour"), F.col("value").alias("raw"))


def pending_issues(files: DataFrame, loaded: DataFrame, expected: int, most: int = 6) -> DataFrame:
    """Issues whose files are there but not loaded (loaded cells below expected); partial files only while nothing is loaded; oldest first."""
    n = loaded.groupBy("issued_hour").agg(F.count(F.lit(1)).alias("n_loaded"))
    rows = files.join(n, "issued_hour", "left").na.fill(0, ["n_loaded"])
    return rows.where((F.col("n_loaded") < expected) & (~F.col("is_partial") | (F.col("n_loaded") == 0))).orderBy("issued_hour").limit(most)
