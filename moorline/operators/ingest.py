"""Snapshots, latest state, attribute history and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["system_id", "station_id"]
VALUES = ("bikes", "docks", "flags", "reported_age_s")


def new_feeds(feeds: DataFrame, ingested: DataFrame) -> DataFrame:
    """Feeds later than the last one ingested for their system."""
    last = ingested.groupBy("system_id").agg(F.max("observed_at").alias("_last"))
    return feeds.join(last, "system_id", "left").where(F.col("_last").isNull() | (F.col("observed_at") > F.col("_last"))).drop("_last")


def assign_ledger(ledger: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """The ledger with new ids appended: dense idx from the system's greatest, by ``order`` of first appearance. Nothing is removed."""
    top = ledger.groupBy("system_id").agg(F.max("idx").alias("_top"))
    new = incoming.groupBy(*KEYS).agg(F.min(order).alias("_o")).join(ledger.select(*KEYS), KEYS, "left_anti")
    rank = F.row_number().over(Window.partitionBy("system_id").orderBy("_o", "station_id"))
    new = new.withColumn("_r", rank).join(top, "system_id", "left")
    return ledger.select(*KEYS, "idx").unionByName(new.select(*KEYS, (F.coalesce("_top", F.lit(-1)) + F.col("_r")).cast("int").alias("idx")))


def _field(name: str):  # noqa: ANN202
    return lambda x: x[name]


def pack(ledger: DataFrame, rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Array rows: for each snapshot(system_id, observed_at) the ledger's values by idx, -1 where a station was not seen.

    Doubled ids in one snapshot are an error.
    """
    full = snapshots.join(ledger, "system_id").join(rows, [*KEYS, "observed_at"], "left")
    item = F.struct("idx", *[F.coalesce(v, F.lit(-1)).cast("short").alias(v) for v in VALUES])
    packed = full.groupBy("system_id", "observed_at").agg(F.array_sort(F.collect_list(item)).alias("_a"), F.count_distinct("idx").alias("_d"))
    sized = F.when(F.size("_a") == F.col("_d"), F.col("_a")).otherwise(F.raise_error(F.lit("an id is listed twice in one snapshot")).cast(packed.schema["_a"].dataType))
    packed = packed.withColumn("_a", sized)
    return packed.select("system_id", "observed_at", *[F.transform("_a", _field(v)).alias(v) for v in VALUES])


def unpack(ledger: DataFrame, arrays: DataFrame) -> DataFrame:
    """Long rows of array snapshots. A short array means stations not registered yet; a longer or unequal one is an error."""
    size = ledger.groupBy("system_id").agg((F.max("idx") + 1).alias("_size"))
    a = arrays.join(size, "system_id")
    same = (F.size("bikes") == F.size("docks")) & (F.size("bikes") == F.size("flags")) & (F.size("bikes") == F.size("reported_age_s")) & (F.size("bikes") <= F.col("_size"))
    zipped = F.arrays_zip(*VALUES)
    a = a.withColumn("_z", F.when(same, zipped).otherwise(F.raise_error(F.lit("arrays of unequal length, or longer than the ledger")).cast(a.select(zipped.alias("z")).schema["z"].dataType)))
    a = a.select("system_id", "observed_at", F.posexplode("_z").alias("idx", "v"))
    return a.join(ledger, ["system_id", "idx"]).select(*KEYS, "observed_at", *[F.col(f"v.{v}").alias(v) for v in VALUES])


def anomalies(ledger: DataFrame, rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Each snapshot with the registered stations it lists; anomalous below ``share`` of those registered before."""
    seen = rows.join(ledger.select(*KEYS), KEYS, "left_semi").groupBy("system_id", "observed_at").agg(F.count_distinct("station_id").alias("n_present"))
    known = ledger.groupBy("system_id").agg(F.count(F.lit(1)).alias("n_registered"))
    out = rows.select("system_id", "observed_at").distinct().join(seen, ["system_id", "observed_at"], "left").join(known, "system_id", "left").na.fill(0, ["n_present", "n_registered"])
    return out.withColumn("is_anomalous", F.col("n_present") < F.col("n_registered") * share)


def insert_once(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows with their outcome: ``inserted``, or ``duplicate`` of a row that is there."""
    there = existing.select(*keys, F.lit(True).alias("_there")).distinct()
    return incoming.join(there, keys, "left").withColumn("outcome", F.when(F.col("_there"), "duplicate").otherwise("inserted")).drop("_there")


def latest_state(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Changed-only latest state after one snapshot.

    ``state(keys, observed_at, bikes, docks, flags, is_present, last_changed_at)`` and
    ``snapshot(keys, observed_at, is_anomalous, bikes, docks, flags)``. Absent stations keep
    their values with is_present false, unless the snapshot is anomalous. A row changes only
    when the snapshot is newer and some value differs; older snapshots never roll back.
    """
    head = snapshot.groupBy("system_id").agg(F.max("observed_at").alias("_at"), F.max("is_anomalous").alias("_anomalous"))
    new = snapshot.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in ("bikes", "docks", "flags")], F.lit(True).alias("_here"))
    both = state.join(new, KEYS, "full_outer").join(head, "system_id", "left")
    here = F.coalesce("_here", F.lit(False))
    newer = F.col("_at").isNotNull() & (F.col("observed_at").isNull() | (F.col("_at") > F.col("observed_at")))
    held = F.coalesce("_anomalous", F.lit(False)) & ~here
    value = {c: F.when(here, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("bikes", "docks", "flags")}
    differs = ~(value["bikes"].eqNullSafe(F.col("bikes")) & value["docks"].eqNullSafe(F.col("docks")) & value["flags"].eqNullSafe(F.col("flags")) & here.eqNullSafe(F.col("is_present")))
    write = newer & ~held & differs
    pick = lambda new, old: F.when(write, new).otherwise(F.col(old)).alias(old)
    return both.select(*KEYS, pick(F.col("_at"), "observed_at"), *[pick(value[c], c) for c in ("bikes", "docks", "flags")], pick(here, "is_present"), pick(F.col("_at"), "last_changed_at"))


def latest_of_history(rows: DataFrame, values: tuple[str, ...] = ("bikes", "docks", "flags")) -> DataFrame:
    """The latest values of each entity and when they last changed, from its whole history."""
    order = Window.partitionBy(*KEYS).orderBy("observed_at", "fetched_at")
    packed = F.struct(*values)
    rows = rows.withColumn("_v", packed).withColumn("_p", F.lag("_v").over(order))
    changed = F.max(F.when(F.col("_p").isNull() | ~F.col("_p").eqNullSafe(F.col("_v")), F.col("observed_at"))).alias("last_changed_at")
    return rows.groupBy(*KEYS).agg(F.max_by("_v", F.struct("observed_at", "fetched_at")).alias("_l"), F.max("observed_at").alias("observed_at"), changed).select(*KEYS, "observed_at", "last_changed_at", "_l.*")


def consecutive_errors(log: DataFrame, key: list[str], order: list[str], ok: Column) -> DataFrame:
    """Failures since the last success at each log row (a success resets to 0)."""
    running = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumn("_ok", ok).withColumn("_run", F.sum(F.col("_ok").cast("int")).over(running))
    inside = Window.partitionBy(*key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("consecutive_errors", F.sum((~F.col("_ok")).cast("int")).over(inside)).drop("_ok", "_run")


def scd2(versions: DataFrame, key: list[str], at: str, order: list[str], values: list[str]) -> DataFrame:
    """Type 2 history of ordered attribute snapshots: a version opens when some value differs from the one before and closes when the next opens."""
    by = Window.partitionBy(*key).orderBy(at, *order)
    rows = versions.withColumn("_v", F.struct(*values)).withColumn("_p", F.lag("_v").over(by))
    opens = rows.where(F.col("_p").isNull() | ~F.col("_p").eqNullSafe(F.col("_v")))
    return opens.withColumn("valid_to", F.lead(at).over(by)).select(*key, F.col(at).alias("valid_from"), "valid_to", *values)


def _met(current: DataFrame, incoming: DataFrame, key: list[str], at: str, values: list[str], loose: dict[str, Column] | None) -> DataFrame:
    """Open versions beside the input, with ``outcome``."""
    new = incoming.select(*key, F.col(at).alias("_at"), *[F.col(v).alias(f"_{v}") for v in values])
    x = current.where(F.col("valid_to").isNull()).join(new, key, "full_outer")
    same = F.lit(True)
    for v in values:
        equal = F.col(v).eqNullSafe(F.col(f"_{v}"))
        same = same & (equal | loose[v] if loose and v in loose else equal)
    outcome = F.when(F.col("_at").isNull(), F.lit(None)).when(F.col("valid_from").isNull(), "new").when(same, "unchanged").when(F.col("_at") > F.col("valid_from"), "changed").otherwise("skipped_older")
    return x.withColumn("outcome", outcome)


def scd2_outcomes(current: DataFrame, incoming: DataFrame, key: list[str], at: str, values: list[str], loose: dict[str, Column] | None = None) -> DataFrame:
    """key and outcome of each id of the input: new, changed, unchanged, or skipped_older (it differs from a version that opened no earlier)."""
    return _met(current, incoming, key, at, values, loose).where("outcome is not null").select(*key, "outcome")


def scd2_merge(current: DataFrame, incoming: DataFrame, key: list[str], at: str, values: list[str], loose: dict[str, Column] | None = None) -> DataFrame:
    """One merge step onto ``current(key, valid_from, valid_to, values)``: all rows to keep, with closed and opened versions.

    Ids absent from the input stay open; input that is not newer than the open version is skipped. ``loose`` names values
    that do not count as changed where a condition on the key holds (a capacity that its system reports as it goes).
    """
    open_ = _met(current, incoming, key, at, values, loose).withColumn("_new", F.coalesce(F.col("outcome").isin("new", "changed"), F.lit(False)))
    kept = open_.where(F.col("valid_from").isNotNull()).select(*key, "valid_from", F.when(F.col("_new"), F.col("_at")).alias("valid_to"), *values)
    opened = open_.where("_new").select(*key, F.col("_at").alias("valid_from"), F.lit(None).cast(current.schema["valid_to"].dataType).alias("valid_to"), *[F.col(f"_{v}").alias(v) for v in values])
    return current.where(F.col("valid_to").isNotNull()).select(*key, "valid_from", "valid_to", *values).unionByName(kept).unionByName(opened)


def at_time(points: DataFrame, history: DataFrame, key: list[str], t: str) -> DataFrame:
    """Attributes valid at each point: valid_from <= t < valid_to. Versions of a key do not overlap, so the last one opened by t is the only candidate: one running window over versions and points, never versions times points. Points without a valid version have no row."""
    values = [c for c in history.columns if c not in key]
    history = history.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    seen = history.select(*key, F.col("valid_from").alias("_time"), F.lit(0).alias("_point"), F.struct(*values).alias("_v")).withColumn("_row", F.lit(None).cast(points.schema))
    ask = points.select(*key, F.col(t).alias("_time"), F.lit(1).alias("_point"), F.lit(None).cast(seen.schema["_v"].dataType).alias("_v"), F.struct(*points.columns).alias("_row"))
    running = Window.partitionBy(*key).orderBy("_time", "_point").rowsBetween(Window.unboundedPreceding, 0)
    rows = seen.unionByName(ask).withColumn("_last", F.last("_v", ignorenulls=True).over(running)).where("_point = 1 and _last is not null")
    return rows.select("_row.*", "_last.*").where(F.col("valid_to").isNull() | (F.col(t) < F.col("valid_to")))


def fold_snapshots(state: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``latest_state`` over many whole snapshots at once, oldest first: one plan, however many there are.

    Each entity meets the snapshots of its system that are newer than its state, from its
    first appearance on; what it lacks is carried over, and the last place where something
    differs from the place before is its state.
    """
    heads = snapshots.groupBy("system_id", "observed_at").agg(F.max("is_anomalous").alias("_anomalous"))
    times = heads.groupBy("system_id").agg(F.array_sort(F.collect_list(F.struct(F.col("observed_at").alias("at"), F.col("_anomalous").alias("anomalous")))).alias("_heads"))  # bounded by the batch's snapshots
    first = snapshots.groupBy(*KEYS).agg(F.min("observed_at").alias("_first"))
    old = state.select(*KEYS, F.struct(*[c for c in state.columns if c not in KEYS]).alias("_old"))
    grid = old.join(first, KEYS, "full_outer").join(times, "system_id", "left")
    none = F.array().cast(times.schema["_heads"].dataType)
    from_ = F.when(F.col("_old").isNull(), F.col("_first"))
    grid = grid.withColumn("_h", F.explode_outer(F.filter(F.coalesce("_heads", none), lambda h: F.when(from_.isNotNull(), h["at"] >= from_).otherwise(h["at"] > F.col("_old.observed_at")))))
    new = snapshots.select(*KEYS, F.col("observed_at").alias("_at"), F.struct("bikes", "docks", "flags").alias("_v"))
    grid = grid.withColumn("_at", F.col("_h.at")).join(new, [*KEYS, "_at"], "left")
    here = F.col("_v").isNotNull()
    order = Window.partitionBy(*KEYS).orderBy("_at")
    carried = F.struct("_old.bikes", "_old.docks", "_old.flags")
    value = F.coalesce(F.last("_v", ignorenulls=True).over(order), F.when(F.col("_old").isNotNull(), carried))
    present = F.coalesce(F.last(F.when(~(F.coalesce("_h.anomalous", F.lit(False)) & ~here), here), ignorenulls=True).over(order), F.col("_old.is_present"))
    rows = grid.withColumn("_value", F.when(F.col("_at").isNotNull(), value).otherwise(carried)).withColumn("_present", F.when(F.col("_at").isNotNull(), present).otherwise(F.col("_old.is_present")))
    now = F.struct("_value", "_present")
    before = F.coalesce(F.lag(now).over(order), F.when(F.col("_old").isNotNull(), F.struct(carried.alias("_value"), F.col("_old.is_present").alias("_present"))))
    rows = rows.withColumn("_changed", F.col("_at").isNotNull() & ~now.eqNullSafe(before))
    last = rows.groupBy(*KEYS).agg(F.max_by(F.struct("_at", "_value", "_present"), F.when(F.col("_changed"), F.col("_at"))).alias("_l"), F.any_value("_old").alias("_old"))
    pick = lambda new, old: F.when(F.col("_l._at").isNotNull(), new).otherwise(F.col(f"_old.{old}")).alias(old)
    return last.select(*KEYS, pick(F.col("_l._at"), "observed_at"), *[pick(F.col(f"_l._value.{c}"), c) for c in ("bikes", "docks", "flags")], pick(F.col("_l._present"), "is_present"), pick(F.col("_l._at"), "last_changed_at"))


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], version: str, guard: Column | None = None) -> DataFrame:
    """Last write wins by ``version``; updates that fail ``guard`` (an expression over update and base columns as u and b) are refused."""
    if guard is not None:
        updates = updates.alias("u").join(base.alias("b"), keys, "left").where(F.coalesce(guard, F.lit(True))).select(*keys, *[F.col(f"u.{c}").alias(c) for c in updates.columns if c not in keys])
    rows = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col(version).desc()))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r", "_new")
