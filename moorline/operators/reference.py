"""Reference data: spatial neighbours, prefixes, capacities, editions, activity; and rolling profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorline.functions.geo import haversine
from moorline.operators import features

KEYS = ["system_id", "station_id"]


def neighbours(stations: DataFrame, radius_m: float, cell_deg: float = 0.01) -> DataFrame:
    """Directed pairs within a radius: grid cells, nine probes each, an equi-join on the cell, then the exact distance.

    A cell must be at least a radius wide. Suspect coordinates take no part.
    """
    s = stations.where(~F.col("geo_suspect") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    s = s.select(*KEYS, "lat", "lon", F.floor(F.col("lat") / cell_deg).alias("cy"), F.floor(F.col("lon") / cell_deg).alias("cx"))
    probe = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    a = s.withColumn("_p", F.explode(probe)).select(*KEYS, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), (F.col("cy") + F.col("_p.y")).alias("cy"), (F.col("cx") + F.col("_p.x")).alias("cx"))
    b = s.select(F.col("system_id").alias("nb_system_id"), F.col("station_id").alias("nb_station_id"), "lat", "lon", "cy", "cx")
    d = haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    rows = a.join(b, ["cy", "cx"]).where(~((F.col("system_id") == F.col("nb_system_id")) & (F.col("station_id") == F.col("nb_station_id"))))
    rows = rows.withColumn("_d", d).where(F.col("_d") <= radius_m)
    return rows.select(*KEYS, "nb_system_id", "nb_station_id", F.round("_d").cast("int").alias("distance_m"), (F.col("system_id") == F.col("nb_system_id")).alias("same_system"))


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str, key: list[str]) -> DataFrame:
    """Each row with the longest listed prefix of its text, or nulls. ``prefixes`` is a bounded reference list.

    Texts are cut to every listed prefix length, so the match is an equi-join.
    """
    lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().collect()]  # a few lengths of a reference list
    cuts = rows.select(*key, text, F.explode(F.array_distinct(F.array(*[F.substring(text, 1, n) for n in lengths]))).alias(prefix))
    found = cuts.join(prefixes, prefix)
    best = found.groupBy(*key).agg(F.max_by(F.struct(*prefixes.columns), F.length(prefix)).alias("_m"))
    return rows.join(best, key, "left").select(*rows.columns, "_m.*")


def places(rows: DataFrame, text: str, first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Each row with the longest listed first-level prefix of its text and, inside it, the longest second-level prefix of the rest.

    ``first(code, name)``, ``second(code, sub_code, sub_name)``: bounded reference lists. Adds code and sub_code, null where
    nothing matches; a second level is looked for among those of the matched first level alone.
    """
    x = longest_prefix(rows, text, first.select(F.col("name").alias("_name"), "code"), "_name", key)
    x = x.withColumn("_rest", F.expr(f"substring(`{text}`, length(_name) + 1)"))
    lengths = [r[0] for r in second.select(F.length("sub_name")).distinct().collect()]  # a few lengths of a reference list
    cuts = x.where("code is not null").select(*key, "code", F.explode(F.array_distinct(F.array(*[F.substring("_rest", 1, n) for n in lengths] or [F.lit("")]))).alias("sub_name"))
    best = cuts.join(second, ["code", "sub_name"]).groupBy(*key).agg(F.max_by("sub_code", F.length("sub_name")).alias("sub_code"))
    return x.join(best, key, "left").select(*rows.columns, "code", "sub_code")


def daily_capacity_max(obs: DataFrame, day: Column) -> DataFrame:
    """Greatest bikes + docks of each entity and day over observed rows; totals beyond 16 bits are noise."""
    total = F.col("bikes") + F.col("docks")
    seen = obs.where((F.col("bikes") != -1) & (F.col("docks") != -1) & (total < 32767))
    return seen.groupBy(*KEYS, day.alias("day")).agg(F.max(total).alias("capacity_max"))


CAPACITY_DAYS = 7  #: how many days an estimate looks back on, its own included


def capacity_estimate(daily: DataFrame, days: int = CAPACITY_DAYS) -> DataFrame:
    """Greatest daily maximum of a day and the ``days - 1`` calendar days before it, and how many days counted."""
    number = F.datediff("day", F.lit("2000-01-01"))
    w = Window.partitionBy(*KEYS).orderBy("_n").rangeBetween(-(days - 1), 0)
    rows = daily.withColumn("_n", number)
    return rows.select(*KEYS, "day", F.max("capacity_max").over(w).alias("capacity_est"), F.count("capacity_max").over(w).cast("int").alias("days_used"))


def capacity_editions(daily: DataFrame, days: int = CAPACITY_DAYS) -> DataFrame:
    """Each entity's estimates by edition, as a map from the edition's day: the greatest daily maximum of the ``days`` days up to it. Editions without such a day are absent."""
    each = daily.select(*KEYS, F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("edition"), "capacity_max")
    each = each.groupBy(*KEYS, "edition").agg(F.max("capacity_max").alias("estimate"))
    return each.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("edition", "estimate"))).alias("estimates"))


def stations_edition(ledger: DataFrame, attributes: DataFrame, estimates: DataFrame) -> DataFrame:
    """Ledger with current attributes and capacity estimate; has_attributes tells unseen ones."""
    out = ledger.join(attributes.withColumn("_has", F.lit(True)), KEYS, "left").join(estimates, KEYS, "left")
    return out.withColumn("has_attributes", F.coalesce("_has", F.lit(False))).drop("_has")


def weather_cells(stations: DataFrame, lat_step: float, lon_step: float) -> DataFrame:
    """Weather cells that hold stations, with how many."""
    cell = lambda c, s: F.rint(F.col(c) / s).cast("int")
    return stations.where(~F.col("geo_suspect")).groupBy(cell("lat", lat_step).alias("lat_idx"), cell("lon", lon_step).alias("lon_idx")).agg(F.count(F.lit(1)).alias("n_ports"))


def activity(arrays: DataFrame, ledger: DataFrame, now: Column, seen_h: int = 25, inactive_h: int = 72) -> DataFrame:
    """last_seen of each station from the last array snapshot of each hour within ``seen_h``; inactive when unseen for ``inactive_h``."""
    hour = F.date_trunc("hour", F.col("observed_at"))
    recent = arrays.where(F.col("observed_at") >= now - F.make_dt_interval(hours=F.lit(seen_h)))
    last = recent.withColumn("_r", F.row_number().over(Window.partitionBy("system_id", hour).orderBy(F.col("observed_at").desc()))).where("_r = 1")
    seen = last.select("system_id", "observed_at", F.posexplode("bikes").alias("idx", "b")).where("b <> -1").groupBy("system_id", "idx").agg(F.max("observed_at").alias("last_seen_at"))
    out = ledger.join(seen, ["system_id", "idx"], "left")
    return out.withColumn("is_active", F.coalesce(F.col("last_seen_at") >= now - F.make_dt_interval(hours=F.lit(inactive_h)), F.lit(False)))


SUMS = features.SUMS


def daily_profile(points: DataFrame, by: list[str]) -> DataFrame:
    """Integer sums of usable points by entity, day kind and slot: ``points`` holds bikes, docks, flags, rentals, returns.

    Suspended points stay: they tell how often a port is of no use.
    """
    from moorline.operators.labels import has_bit, y_bike, y_dock

    up = has_bit(F.col("flags"), 2) & has_bit(F.col("flags"), 4)
    return points.groupBy(*KEYS, *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~up).alias("n_suspended"),
        F.sum(y_bike(F.col("bikes"), F.col("flags"))).alias("n_bike_ok"),
        F.sum(y_dock(F.col("docks"), F.col("flags"))).alias("n_dock_ok"),
        F.sum(F.col("bikes").cast("long")).alias("sum_bikes"),
        F.sum((F.col("bikes") * F.col("bikes")).cast("long")).alias("sum_bikes_sq"),
        F.sum(F.coalesce("rentals", F.lit(0)).cast("long")).alias("sum_rentals"),
        F.sum(F.coalesce("returns", F.lit(0)).cast("long")).alias("sum_returns"),
    )


CELL = [*KEYS, "dow_type", "slot15"]


def sum_dailies(daily: DataFrame, by: list[str] = CELL) -> DataFrame:
    """A profile as the plain sum of daily ones; n_days counts them."""
    return daily.groupBy(*by).agg(F.count(F.lit(1)).alias("n_days"), *[F.sum(c).alias(c) for c in SUMS])


def roll(previous: DataFrame, today: DataFrame, expired: DataFrame, by: list[str] = CELL) -> DataFrame:
    """previous + today - expired as one signed union; cells without days fall away."""
    cols = ["n_days", *SUMS]
    signed = lambda df, s: df.select(*by, *[(F.col(c) * s).alias(c) for c in cols])
    one = lambda df: df.withColumn("n_days", F.lit(1).cast("long"))
    rows = signed(previous, 1).unionByName(signed(one(today), 1)).unionByName(signed(one(expired), -1))
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols]).where("n_days > 0")


def serving_cells(at: DataFrame, horizons: tuple[int, ...], slot_min: int) -> DataFrame:
    """The (dow_type, slot) cells that serving at times ``at(t, minute, dow, dow_next)`` needs."""
    m = F.col("minute") + F.col("h")
    rows = at.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return rows.select("t", F.when(m >= 1440, F.col("dow_next")).otherwise(F.col("dow")).alias("dow_type"), F.floor((m % 1440) / slot_min).cast("int").alias("slot15")).distinct()


def edition(available: DataFrame, wanted: DataFrame, day: str, most_back: int = 2) -> DataFrame:
    """The newest edition before each wanted day, at most ``most_back`` days old."""
    rows = wanted.select(day).distinct().select(day, F.explode(F.sequence(F.lit(1), F.lit(most_back))).alias("_b")).withColumn("edition", F.date_sub(day, F.col("_b")))
    found = rows.join(available.select(F.col("day").alias("edition")).distinct(), "edition", "left_semi").groupBy(day).agg(F.max("edition").alias("edition"))
    return wanted.select(day).distinct().join(found, day, "left")


def summarize(profile: DataFrame, floors: dict[str, int]) -> DataFrame:
    """Cells, cells over the serving floor, ports, greatest days and suspended share by day kind."""
    floor = F.element_at(F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v))]), F.col("dow_type"))
    return profile.groupBy("dow_type").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(F.col("n_days") >= floor).alias("n_served"),
        F.count_distinct(*KEYS).alias("n_ports"),
        F.max("n_days").alias("max_days"),
        F.round(F.sum("n_suspended") / F.sum("n"), 9).alias("suspended_share"),
    )
