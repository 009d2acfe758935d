"""Steps whose rows grow from a small table, or whose sizes no estimate sees: they stay dealt over tasks and out of broadcasts."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from moorline.operators import features, reference
from moorline.plans import q_eval, q_features, q_grid, q_ingest, q_models, q_stream
from moorline.sources import files, tables
from moorline.streaming import streams


def tasks(df):
    return df.select(F.spark_partition_id()).distinct().count()


def plan(df):
    return df._jdf.queryExecution().toString()


def test_weather_cells_are_never_broadcast(spark, sf_dir):
    joins = [x for x in plan(q_features.fea_14_weather(spark, sf_dir)).split("== Physical Plan ==")[1].splitlines() if "Join" in x and "lat_idx" in x]
    assert joins and all("SortMergeJoin" in x for x in joins), joins


def sent_whole(df):
    """Steps of the run of df that grow grid times of entities and send the grown rows to every task, with no shuffle between that would count them."""
    df.collect()
    above, out = [], []
    for x in plan(df).split("== Final Plan ==")[1].split("== Initial Plan ==")[0].splitlines():
        depth = len(x) - len(x.lstrip(" :+-"))
        above = [(d, y) for d, y in above if d < depth]
        if "Generate explode" in x and "station_id" in x and "[t#" in x.rsplit(", ", 1)[-1]:
            out += [x.strip() for _, y in [z for z in above if "Exchange" in z[1]][-1:] if "BroadcastExchange" in y]
        above.append((depth, x))
    return out


def test_served_forecasts_are_never_broadcast(spark, sf_dir):
    assert not sent_whole(q_eval.eva_09_served(spark, sf_dir))


@pytest.fixture
def bound(spark):
    """As where tables are large: a broadcast may be larger than the entities that a run counts and no larger than the stations or any file."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "2KB")
    yield
    spark.conf.set(name, old)


@pytest.mark.parametrize("name", ["fea_14_weather", "fea_18_coverage", "fea_18_spread"])
def test_points_of_weather_are_never_broadcast(spark, sf_dir, bound, name):
    assert not sent_whole(q_features.QUERIES[name](spark, sf_dir))


def test_points_with_facts_are_those_of_known_entities(spark, sf_dir):
    facts = tables.stations(spark, sf_dir).where("capacity > 9").select(*q_grid.KEYS, "capacity")
    early, late = q_grid.grid_points(spark, sf_dir, facts), q_grid.grid_points(spark, sf_dir).join(facts, q_grid.KEYS)
    assert sorted(map(str, early.select(*late.columns).collect())) == sorted(map(str, late.collect())) != []


def test_points_and_weather_cells_are_dealt_before_they_grow(spark, sf_dir):
    assert tasks(q_grid.grid_points(spark, sf_dir)) > 1
    assert tasks(q_features.weather(spark, sf_dir)[1]) > 1
    assert tasks(q_ingest.weather_places(spark, sf_dir)) > 1


def test_weather_cells_grow_asked_hours_alone(spark, sf_dir):
    times = q_features.grid_times(spark).where("t <= '2024-01-03'")
    issues, cells = q_features.weather(spark, sf_dir, times)
    asked = {r.issued_hour for r in features.issue_times(times, issues).collect()} - {None}
    assert asked and {r.issued_hour for r in cells.select("issued_hour").distinct().collect()} == asked
    assert cells.select("issued_hour", "lat_idx", "lon_idx").distinct().count() == cells.count()


def test_a_point_build_makes_its_little_grid_once_and_sums_its_one_edition(spark, sf_dir):
    steps = plan(q_features.fea_17_point_build(spark, sf_dir)).split("== Physical Plan ==")[1].splitlines()
    assert len([x for x in steps if "Window" in x and "RangeFrame" in x and "rentals" in x]) <= 1  # that of the edition's days
    assert not [x for x in steps if "Window" in x and "_ask" in x]


def test_an_edition_joined_equals_an_edition_in_the_running_sums(spark):
    day = lambda n, **c: (*{"s": "s", "x": "x", "k": "sat", "slot": 3, **c}.values(), dt.date(2024, 1, n), *[n] * 8)
    daily = spark.createDataFrame([day(1), day(2), day(9), day(5, slot=4)], "system_id string, station_id string, dow_type string, slot15 int, day date, " + ", ".join(f"{c} long" for c in features.SUMS))
    rows = spark.createDataFrame([("s", "x", "sat", 3), ("s", "x", "sat", 4), ("s", "x", "weekday", 3), ("s", "y", "sat", 3), ("s", "x", None, 3)], "system_id string, station_id string, dow string, slot int")
    within = reference.sum_dailies(daily.where("day between '2023-12-12' and '2024-01-08'"))
    a = features.with_profile(rows, daily, 28, F.to_date(F.lit("2024-01-08")), "slot", "dow")
    b = features.with_edition(rows, within, "slot", "dow")
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_an_issue_has_a_weather_file_for_each_tile(spark, tmp_path):
    path, hour = str(tmp_path / "w"), dt.datetime(2026, 9, 7)
    rows = [(hour, t, f'{{"latitude": {35.0 + i}}}') for i, t in enumerate(("a", "a", "b"))]
    files.write_weather(spark.createDataFrame(rows, "issued_hour timestamp_ntz, tile string, place string"), path)
    got = files.scan_weather(spark, path).collect()
    assert {r.issued_hour for r in got} == {hour} and sorted(r.raw.count("latitude") for r in got) == [1, 2]
    assert all(r.raw.strip().startswith("[") and r.raw.strip().endswith("]") for r in got)


def test_stations_are_dealt_before_they_meet_their_neighbours(spark, sf_dir):
    assert tasks(q_features.edges(spark, sf_dir)) > 1


def test_weather_texts_are_neither_shuffled_nor_sorted(spark, sf_dir, tmp_path):
    tiles = q_ingest.weather_places(spark, sf_dir)
    steps = plan(tiles).split("== Physical Plan ==")[1].splitlines()
    value = next(i for i, x in enumerate(steps) if "AS value" in x)
    assert value < min(i for i, x in enumerate(steps) if "Sort " in x or "Exchange " in x or "Aggregate" in x)
    path = str(tmp_path / "w")
    files.write_tiles(tiles, path)
    got = files.weather_batch(files.scan_weather(spark, path), "issued_hour", 0.05, 0.0625, 8, 9)
    assert got.count() == got.select("issued_hour", "lat_idx", "lon_idx").distinct().count() > 0


def test_a_slice_of_many_files_is_still_one_batch(spark, monkeypatch):
    monkeypatch.setattr(q_stream, "FILE_BYTES", 512)
    days = [dt.datetime(2024, 1, d) for d in (1, 6, 11, 16, 26)]  # no row from 21 January on, and few from the 26th
    rows = [(t, n) for t in days for n in range(3 if t.day == 26 else 400)]
    stream = q_stream.stream_of(spark, spark.createDataFrame(rows, "at timestamp_ntz, n int").repartition(4), "many", "at")
    seen = []
    q_stream.folded(stream, lambda batch, _: seen.append((sorted(r[0].day for r in batch.select("at").distinct().collect()), batch.count(), batch.rdd.getNumPartitions())), "many")
    assert [(d, n) for d, n, _ in seen] == [([1], 400), ([6], 400), ([11], 400), ([16], 400), ([], 0), ([26], 3)]
    assert seen[0][2] > 1


class Store:
    """A state store of one key that counts its calls."""

    def __init__(self):
        self.calls, self.held = 0, None

    def getValueState(self, name, schema):  # noqa: N802
        return self

    getListState = getValueState  # noqa: N815

    def get(self):
        self.calls += 1
        return self.held

    def exists(self):
        self.calls += 1
        return self.held is not None

    def update(self, value):
        self.calls += 1
        self.held = value

    put = update

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1

    deleteTimer = registerTimer  # noqa: N815

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return []


def test_the_flow_of_a_batch_asks_the_state_store_four_times_at_most():
    store, flow = Store(), streams.Flow(60, 180, 1440)
    flow.init(store)
    for at, bikes in ((0, 5), (10, 3)):
        store.calls = 0
        us = at * 60_000_000
        (out,) = flow.handleInputRows(("s", "x"), iter([pd.DataFrame({"us": [us], "fetched_us": [us], "bikes": [bikes]})]), None)
        assert store.calls <= 4
    assert out.iloc[0].tolist()[2:] == [600_000_000, 2, 0, 1, 0.0]


def test_the_chain_reads_its_own_columns_of_samples_and_no_others(spark, sf_dir):
    """What the chain does not read is in no window of its samples; what it reads equals the whole samples' columns."""
    some = q_features.samples(spark, sf_dir, q_models.CHAIN_COLUMNS)
    assert some.columns == q_models.CHAIN_COLUMNS
    steps = plan(some).split("== Physical Plan ==")[1].splitlines()
    assert not [x for x in steps if "Window" in x and ("nb_docks" in x or "wind_kmh" in x or "urban_density" in x)]
    whole = q_features.fea_16_samples(spark, sf_dir).select(*q_models.CHAIN_COLUMNS)
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.collect()))
