"""Point-in-time features: state, lags, rolling, flow, history, neighbours, weather and profile lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorline.operators.labels import y_bike, y_dock
from moorline.operators.timegrid import micros, minutes

KEYS = ["system_id", "station_id"]
US = 60_000_000  #: microseconds in a minute
SUMS = ("n", "n_suspended", "n_bike_ok", "n_dock_ok", "sum_bikes", "sum_bikes_sq", "sum_rentals", "sum_returns")  #: of a profile cell


def capacity(system: Column, declared: Column, estimate: Column, dynamic: tuple[str, ...]) -> Column:
    """Dynamic systems use the estimate, others the declared value; not positive is unknown."""
    c = F.when(system.isin(*dynamic), estimate).otherwise(declared) if dynamic else declared
    return F.when(c > 0, c)


def fill_ratio(bikes: Column, cap: Column) -> Column:
    return F.try_divide(bikes, F.when(cap > 0, cap))


def gap(system: Column, cap: Column, bikes: Column, docks: Column, gap_systems: tuple[str, ...]) -> Column:
    return F.when(system.isin(*gap_systems), cap - bikes - docks)


def lags(state: DataFrame, step_min: int, lags_min: tuple[int, ...], deltas_min: tuple[int, ...], value: str = "bikes") -> DataFrame:
    """lag_k and delta_k over a dense grid with a ``valid`` flag: null unless both points are valid."""
    w = Window.partitionBy(*KEYS).orderBy("t")
    held = {f"_l{m}": F.when(F.col("valid"), F.lag(F.when(F.col("valid"), F.col(value)), m // step_min).over(w)) for m in sorted({*lags_min, *deltas_min})}
    named = {f"lag_{m}": F.col(f"_l{m}") for m in lags_min} | {f"delta_{m}": F.col(value) - F.col(f"_l{m}") for m in deltas_min}
    return state.withColumns(held).withColumns(named).drop(*held)


def rolling(state: DataFrame, step_min: int, roll_min: int, value: str = "bikes") -> DataFrame:
    """Mean, minimum and maximum over the points of the last ``roll_min`` minutes, both ends included; invalid points do not count."""
    w = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(-(roll_min // step_min), 0)
    v = F.when(F.col("valid"), F.col(value))
    return state.withColumns({"roll_mean": F.avg(v).over(w), "roll_min": F.min(v).over(w), "roll_max": F.max(v).over(w)})


def flow(obs: DataFrame, window_min: int, cap_min: int, keep: list[str] | None = None) -> DataFrame:
    """Native-cadence flow at each observation: rentals, returns and changes over the half-open (at - window, at], and minutes since the last change.

    Changes are between consecutive observed rows of an entity; its first row changes nothing. With ``keep`` all observations stay, with those columns;
    the flow of unobserved ones is null.
    """
    observed = F.col("bikes") != -1
    seen = (obs if keep else obs.where(observed)).withColumns({"_us": micros(F.col("observed_at")), "_ok": observed})
    keys = [*KEYS, "_ok"] if keep else KEYS
    order = Window.partitionBy(*keys).orderBy("observed_at", "fetched_at")
    seen = seen.withColumns({"_d": F.col("bikes") - F.lag("bikes").over(order), "_n": F.row_number().over(order)})
    back = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-window_min * US + 1, 0)
    running = Window.partitionBy(*keys).orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(back), F.lit(0)).cast("int")
    last = F.max(F.when(F.col("_d") != 0, F.col("_us"))).over(running)
    since = F.least(F.coalesce((F.col("_us") - last) / US, F.lit(float(cap_min))), F.lit(float(cap_min)))
    known = lambda c: F.when(F.col("_ok"), c) if keep else c
    return seen.select(
        *KEYS,
        "observed_at",
        "fetched_at",
        *(keep or []),
        known(total(F.greatest(-F.col("_d"), F.lit(0)))).alias("rentals"),
        known(total(F.greatest("_d", F.lit(0)))).alias("returns"),
        known(total((F.col("_d") != 0).cast("int"))).alias("n_changes"),
        known(F.when(F.max("_n").over(running) >= 2, since)).alias("since_change_min"),
    )


def yesterday(state: DataFrame, points: DataFrame, fields: dict[str, Column], shift_min: int = 1440) -> DataFrame:
    """The state a day before each point, by an equi-join on the shifted time; fields are null where it was not valid."""
    old = state.select(*KEYS, (F.col("t") + minutes(shift_min)).alias("t"), *[F.when(F.col("valid"), c).alias(n) for n, c in fields.items()])
    return points.join(old, [*KEYS, "t"], "left")


def neighbour_sums(state: DataFrame, edges: DataFrame, near_m: int, far_m: int, points: DataFrame | None = None) -> DataFrame:
    """Aggregates over each entity's neighbours at each time, all systems and own system.

    ``edges(system_id, station_id, nb_system_id, nb_station_id, distance_m, same_system)``;
    ``state(keys, t, bikes, docks, capacity)``. Within near_m: sums of bikes and docks (-1
    counts 0). Within far_m: how many are empty, and the mean fill ratio. Only known
    neighbours count; staleness does not matter here. Points without neighbours have no
    row: sums are then 0 and means null (``join_neighbours``). With ``points(keys, t)`` only
    their neighbours' states are looked at, by an equi-join on (neighbour, t).
    """
    nb = state.select(F.col("system_id").alias("nb_system_id"), F.col("station_id").alias("nb_station_id"), "t", "bikes", "docks", F.when(F.col("bikes") >= 0, fill_ratio(F.col("bikes"), F.col("capacity"))).alias("fill"))
    around = edges.where(F.col("distance_m") <= far_m)
    if points is None:
        rows = around.join(nb, ["nb_system_id", "nb_station_id"])
    else:
        rows = points.select(*KEYS, "t").join(around, KEYS).join(nb, ["nb_system_id", "nb_station_id", "t"])
    near = F.col("distance_m") <= near_m
    known = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    out = []
    for suffix, own in (("", F.lit(True)), ("_same", F.col("same_system"))):
        out += [
            F.sum(F.when(near & own, known("bikes")).otherwise(0)).alias(f"nb_bikes{suffix}"),
            F.sum(F.when(near & own, known("docks")).otherwise(0)).alias(f"nb_docks{suffix}"),
            F.count_if((F.col("bikes") == 0) & own).alias(f"nb_empty{suffix}"),
            F.count_if(own).alias(f"nb_count{suffix}"),
            F.count_if(near & own).alias(f"nb_count_near{suffix}"),
            F.avg(F.when(own, F.col("fill"))).alias(f"nb_fill{suffix}"),
        ]
    return rows.groupBy(*KEYS, "t").agg(*out)


def join_neighbours(points: DataFrame, sums: DataFrame) -> DataFrame:
    out = points.join(sums, [*KEYS, "t"], "left")
    counts = [c for c in sums.columns if c.startswith("nb_") and "fill" not in c]
    return out.na.fill(0, counts)


def issue_times(grid: DataFrame, issues: DataFrame) -> DataFrame:
    """(t, issued_hour) of distinct grid times: the newest weather issue available at each, null where none was. An issue with two times counts from the later one."""
    once = issues.groupBy("issued_hour").agg(F.max("available_at").alias("_time"))
    rows = once.select("_time", F.lit(0).alias("_p"), F.col("issued_hour").alias("_i"), F.lit(None).cast("timestamp_ntz").alias("t"))
    ask = grid.select(F.col("t").alias("_time"), F.lit(1).alias("_p"), F.lit(None).cast("timestamp_ntz").alias("_i"), "t")
    w = Window.orderBy("_time", "_p").rowsBetween(Window.unboundedPreceding, 0)  # no key: one row for each grid time and issue, whatever the entities
    return rows.unionByName(ask).withColumn("issued_hour", F.max("_i").over(w)).where("_p = 1").select("t", "issued_hour")


def newest_cells(points: DataFrame, issues: DataFrame, cells: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """points(t, lat_idx, lon_idx) with the newest issue's hour and its cell's arrays, null where the cell has none. ``grid``: a cheaper source of the same times.

    Only the issues that some grid time asks for are looked at. Cells may have grown their hours by an explode, which
    no estimate of their size counts: they are joined by a sort, never broadcast.
    """
    times = issue_times((grid if grid is not None else points).select("t").distinct(), issues)
    asked = cells.join(F.broadcast(times.select("issued_hour").distinct()), "issued_hour", "left_semi")
    return points.join(F.broadcast(times), "t").join(asked.hint("merge"), ["issued_hour", "lat_idx", "lon_idx"], "left")


def yesterday_lags(state: DataFrame, step_min: int, horizons_min: tuple[int, ...]) -> DataFrame:
    """bikes_yesterday (at t - 1 day) and history(h_min, y_bike_yesterday, y_dock_yesterday) at t + h - 1 day for each horizon.

    Row lags over the dense grid (``state`` holds bikes, docks, flags, valid): a row lag is a
    time lag, so nothing is joined. What was not valid is null; only states known by t are read.
    """
    w = Window.partitionBy(*KEYS).orderBy("t")
    old = lambda back, c: F.lag(F.when(F.col("valid"), c), back // step_min).over(w) if back else F.when(F.col("valid"), c)
    both = F.struct(y_bike(F.col("bikes"), F.col("seen.flags")).alias("bike"), y_dock(F.col("docks"), F.col("seen.flags")).alias("dock"))
    out = state.withColumns({"bikes_yesterday": old(1440, F.col("bikes"))} | {f"_y{h}": old(1440 - h, both) for h in horizons_min})
    history = F.array(*[F.struct(F.lit(h).alias("h_min"), F.col(f"_y{h}.bike").alias("y_bike_yesterday"), F.col(f"_y{h}.dock").alias("y_dock_yesterday")) for h in horizons_min])
    return out.withColumn("history", history).drop(*[f"_y{h}" for h in horizons_min])


def with_profile(rows: DataFrame, daily: DataFrame, days: int, edition: Column, slot: str, dow: str) -> DataFrame:
    """Profile ratios of each row's cell (entity, ``dow``, ``slot``) in the edition of a day: the sums of the ``days`` days up to it.

    A daily profile enters the running sums on its day and leaves them ``days`` later, and rows
    travel through that window themselves: one shuffle on the cell, no edition is stored or
    copied. A cell without days has prof_n_days 0 and null ratios.
    """
    cell = [*KEYS, "dow_type", "slot15"]
    step = F.explode(F.array(F.struct(F.col("day").alias("at"), F.lit(1).cast("long").alias("sign")), F.struct(F.date_add("day", days).alias("at"), F.lit(-1).cast("long").alias("sign")))).alias("_s")
    steps = daily.select(*cell, *SUMS, step).select(*cell, F.col("_s.at").alias("day"), F.lit(0).alias("_ask"), F.col("_s.sign").alias("n_days"), *[(F.col("_s.sign") * F.col(c)).alias(c) for c in SUMS])
    none = [F.lit(0).cast("long").alias(c) for c in ("n_days", *SUMS)]
    ask = rows.select(*KEYS, F.col(dow).alias("dow_type"), F.col(slot).alias("slot15"), edition.alias("day"), F.lit(1).alias("_ask"), *none, F.struct(*rows.columns).alias("_row"))
    steps = steps.withColumn("_row", F.lit(None).cast(ask.schema["_row"].dataType))
    running = Window.partitionBy(*cell).orderBy("day", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.unionByName(ask)
    sums = sums.select("_ask", "_row", *[F.sum(c).over(running).alias(c) for c in ("n_days", *SUMS)]).where("_ask = 1")
    return sums.select("_row.*", F.col("n_days").cast("int").alias("prof_n_days"), *[e.alias(n) for n, e in profile_ratios().items()])


def with_edition(rows: DataFrame, profile: DataFrame, slot: str, dow: str) -> DataFrame:
    """The same of one edition that is summed already: the rows join their cells, and no day travels through a window."""
    cells = profile.select(*KEYS, F.col("dow_type").alias("_dow"), F.col("slot15").alias("_at"), F.col("n_days").cast("int").alias("prof_n_days"), *[e.alias(n) for n, e in profile_ratios().items()])
    kind, at = rows[dow], rows[slot]
    found = rows.withColumns({"_dow": kind, "_at": at}).join(cells, [*KEYS, "_dow", "_at"], "left").drop("_dow", "_at")
    return found.na.fill(0, ["prof_n_days"])


def lead_of(issued: Column, hour: Column, leads: int) -> Column:
    """Index of an hour in an issue's arrays, or null outside them."""
    n = ((micros(hour) - micros(issued)) / (60 * US)).cast("int")
    return F.when(n.between(0, leads - 1), n)


def containing_hour(t: Column) -> Column:
    """The hour that ends at or after t: rain of the hour that contains t."""
    floor = F.date_trunc("hour", t).cast("timestamp_ntz")
    return F.when(floor == t, t).otherwise(floor + minutes(60))


def nearest_hour(t: Column) -> Column:
    """The nearest hour, half up."""
    return F.date_trunc("hour", t + minutes(30)).cast("timestamp_ntz")


def target_slot(minute: Column, h_min: Column, slot_min: int) -> Column:
    return F.floor(((minute + h_min) % 1440) / slot_min).cast("int")


def profile_ratios(n: str = "n") -> dict[str, Column]:
    """Ratios derived from a profile cell's integer sums."""
    d = F.when(F.col(n) > 0, F.col(n))
    mean = F.col("sum_bikes") / d
    return {
        "prof_p_bike": F.col("n_bike_ok") / d,
        "prof_p_dock": F.col("n_dock_ok") / d,
        "prof_mean": mean,
        "prof_std": F.when(d.isNotNull(), F.sqrt(F.greatest(F.col("sum_bikes_sq") / d - mean * mean, F.lit(0.0)))),
        "prof_rentals": F.col("sum_rentals") / d,
        "prof_returns": F.col("sum_returns") / d,
    }


def coverage(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows, rows with every column known, and known counts by column."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("n_all"), *[F.count(c).alias(f"n_{c}") for c in columns])


def spread_pp(cover: DataFrame, part: str, whole: str) -> DataFrame:
    """Greatest difference of a share between days, in percentage points."""
    share = F.col(part) / F.col(whole) * 100
    return cover.agg((F.max(share) - F.min(share)).alias("spread_pp"))


def encode(df: DataFrame, vocabularies: dict[str, tuple[str, ...]], flags: list[str]) -> DataFrame:
    """Model columns: fixed vocabularies to their index (null stays null, an unknown value is an error), booleans to 0 and 1."""
    for c, words in vocabularies.items():
        table = F.create_map(*[x for i, w in enumerate(words) for x in (F.lit(w), F.lit(float(i)))])
        known = F.col(c).isNull() | F.col(c).isin(*words)
        df = df.withColumn(c, F.when(known, table[F.col(c)]).otherwise(F.raise_error(F.concat(F.lit(f"unknown {c}: "), F.col(c))).cast("double")))
    for c in flags:
        df = df.withColumn(c, F.col(c).cast("int").cast("double"))
    return df


def refuse_if_mixed(cover: DataFrame, part: str, whole: str, most_pp: float = 3.0) -> DataFrame:
    """The coverage table, or an error when days of different coverage are mixed."""
    s = spread_pp(cover, part, whole)
    bad = F.raise_error(F.format_string("coverage differs by %.2f points between days", F.col("spread_pp"))).cast("boolean")
    return cover.join(s).where(F.when(F.col("spread_pp") > most_pp, bad).otherwise(True)).drop("spread_pp")
