"""Merging sinks, ordered replay, clustered boxes, merge outcomes and refusals."""

import datetime as dt
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from moorline.operators import archive, ingest, keyed, layout, reference, replay, sampling, timegrid
from moorline.plans.scratch import folder, written


def files_of(path):
    return {p.relative_to(path).as_posix(): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


SCHEMA = "k int, day string, v int, x string"


def test_a_merge_rewrites_what_it_changes_and_nothing_else(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda rows, guard=None: keyed.merge(spark, path, spark.createDataFrame(rows, SCHEMA), ["k", "day"], "v", ["day"], written, guard)
    assert put([(k, day, 1, "a") for k in range(20) for day in "pqr"]) == 3
    before = files_of(path)
    # One partition: a newer row, an older one (refused), an equal one, two of one key (the newer counts).
    updates = [(1, "q", 2, "b"), (2, "q", 0, "b"), (3, "q", 1, "a"), (4, "q", 3, "c"), (4, "q", 5, "d"), (2, "p", 0, "z"), (7, "r", 1, "a")]
    assert put(updates) == 1
    after = files_of(path)
    assert {f for f in after if after[f] == before.get(f)} == {f for f in before if not f.startswith("day=q")}
    rows = {(r.k, r.day): (r.v, r.x) for r in spark.read.schema(SCHEMA).parquet(path).collect()}
    assert len(rows) == 60 and rows[1, "q"] == (2, "b") and rows[2, "q"] == (1, "a") and rows[4, "q"] == (5, "d")
    # The same again changes no file; a guard refuses; a new key of a new partition comes beside.
    assert put(updates) == 0 and files_of(path) == after
    assert put([(1, "q", 9, "e")], F.col("u.v") < F.col("b.v") + 3) == 0
    assert put([(99, "s", 0, "n")]) == 1 and spark.read.parquet(path).count() == 61
    assert {f: t for f, t in files_of(path).items() if f in after} == after


def test_a_forecast_cycle_that_runs_again_replaces_itself(spark, tmp_path):
    at = lambda h, m: dt.datetime(2026, 1, 1, h, m)
    rows = [("s", str(k), at(3, m), [5], [k], v) for k in range(5) for m in (0, 5) for v in ("v1", "v2")]
    df = spark.createDataFrame(rows, "system_id string, station_id string, base_observed_at timestamp_ntz, horizons_min array<int>, p_bike_x1000 array<int>, model_version string")
    path = str(tmp_path / "log")
    for part in (df, df.where("minute(base_observed_at) = 5 and model_version = 'v1'"), df):
        archive.write_forecast_log(part, path)
        assert spark.read.parquet(path).count() == 20
    one = spark.read.parquet(path).where("version = 'v2' and hour = 3")
    assert one.count() == 10 and {r.model_version for r in one.collect()} == {"v2"}


def feed(epoch, stations):
    return json.dumps({"last_updated": epoch, "ttl": 60, "data": {"stations": [{"station_id": s, "num_bikes_available": b, "num_docks_available": 3, "is_installed": True, "is_renting": True, "is_returning": True, "last_reported": epoch - 5} for s, b in stations]}})


def raw_files(spark, root, n=12):
    """Feeds of two systems, of which some repeat an observation and one is broken."""
    rng, rows = random.Random(2), []
    for system in "ab":
        for i in range(n):
            epoch = 1_704_067_200 + i * 21_600
            body = "{broken" if (system, i) == ("a", 4) else feed(epoch - (21_600 if i == 7 else 0), [(f"{system}{k}", rng.randrange(9)) for k in range(5) if rng.random() < 0.8])
            at = Path(root) / f"system_id={system}" / f"file={epoch}.json"
            at.mkdir(parents=True)
            (at / "part.json").write_text(body)
            rows.append((system, epoch, str(at)))
    return spark.createDataFrame(rows, "system_id string, epoch_s long, path string")


def test_a_replay_in_pieces_equals_one_whole_run(spark, tmp_path):
    files = raw_files(spark, tmp_path / "raw")
    read = lambda t: (sorted(map(str, spark.read.parquet(f"{t}/rows").drop("batch").collect())), sorted(map(str, replay.state_of(spark, t).collect())))
    whole, pieces, cut = (str(tmp_path / n) for n in ("whole", "pieces", "cut"))
    once = F.lit("all")
    assert replay.replay(spark, files, whole, once) == 1
    assert replay.replay(spark, files, pieces, most=1) == 1 and replay.replay(spark, files, pieces) == 2
    assert replay.replay(spark, files, pieces) == 0  # nothing is left
    assert read(pieces) == read(whole)
    rows = spark.read.parquet(f"{whole}/rows")
    assert rows.select("system_id", "observed_at", "station_id").distinct().count() == rows.count()
    assert spark.read.parquet(f"{whole}/quarantine").count() == 1
    # Cut short after its rows and state were written: the chunk is applied again and nothing doubles.
    replay.replay(spark, files, cut, most=2)
    import shutil

    shutil.rmtree(f"{cut}/done/batch=1")
    replay.replay(spark, files, cut)
    assert read(cut) == read(whole)


def test_recompaction_touches_its_days_alone(spark, tmp_path):
    rows = spark.createDataFrame([("s", str(k), dt.datetime(2026, 1, d, h), k) for k in range(3) for d in (1, 2, 3) for h in (0, 5)], "system_id string, station_id string, observed_at timestamp_ntz, bikes int")
    path = str(tmp_path / "archive")
    archive.write_hourly(rows, path)
    before = files_of(path)
    replay.recompact(rows.withColumn("bikes", F.col("bikes") + 10), path, "2026-01-02", "2026-01-02")
    after = files_of(path)
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if "date=2026-01-02" not in f}
    assert {(r.day, r.low) for r in spark.read.parquet(path).groupBy(F.dayofmonth("observed_at").alias("day")).agg(F.min("bikes").alias("low")).collect()} == {(1, 0), (2, 10), (3, 0)}


def test_box_ranges_cover_the_box_and_are_few():
    rng = random.Random(1)
    for _ in range(30):
        w, s = rng.uniform(130, 140), rng.uniform(30, 40)
        e, n = w + rng.uniform(0, 0.5), s + rng.uniform(0, 0.5)
        got = layout.ranges(w, s, e, n)
        assert 1 <= len(got) <= 16 and all(a <= b for a, b in got) and all(x[1] < y[0] for x, y in zip(got, got[1:], strict=False))
        for _ in range(50):
            y, x = (int(round((v - low) / 0.01, 9)) for v, low in ((rng.uniform(s, n), -90.0), (rng.uniform(w, e), -180.0)))
            c = sum(((y >> i) & 1) << (2 * i) | ((x >> i) & 1) << (2 * i + 1) for i in range(16))
            assert any(a <= c <= b for a, b in got)


def test_a_box_reads_few_row_groups(spark, tmp_path):
    n = 200_000
    df = spark.range(n).select("id", (F.lit(35.0) + (F.xxhash64("id") % 10_000 + 10_000) / 20_000).alias("lat"), (F.lit(139.0) + (F.xxhash64("id", F.lit(1)) % 10_000 + 10_000) / 20_000).alias("lon"))
    df = df.unionByName(spark.createDataFrame([(-1, None, None)], "id long, lat double, lon double"))
    path = str(tmp_path / "boxes")
    layout.write(df, path, 16)
    box = (139.3, 35.3, 139.34, 35.35)
    got = layout.inside(spark.read.parquet(path), *box)
    plan = got._jdf.queryExecution().executedPlan()
    ids = {r.id for r in got.collect()}
    assert ids == {r.id for r in df.where("lat between 35.3 and 35.35 and lon between 139.3 and 139.34").collect()} and len(ids) > 100

    def scanned(p):
        if "Scan" in p.nodeName() and p.metrics().contains("numOutputRows"):
            return p.metrics().apply("numOutputRows").value()
        return sum(scanned(p.children().apply(i)) for i in range(p.children().length()))

    assert 0 < scanned(got._jdf.queryExecution().executedPlan()) < n / 4, plan.toString()


def test_merge_outcomes(spark):
    day = lambda d: dt.datetime(2026, 1, d)
    current = spark.createDataFrame([("1", day(5), None, "n", 4), ("2", day(5), None, "n", 4), ("3", day(5), None, "n", 4), ("4", day(5), None, "n", 4), ("5", day(5), None, None, None), ("9", day(1), None, "n", 4)], "k string, valid_from timestamp_ntz, valid_to timestamp_ntz, name string, capacity int")
    incoming = spark.createDataFrame([("1", day(6), "m", 4), ("2", day(5), "m", 4), ("3", day(9), "n", 7), ("4", day(9), "n", 4), ("5", day(9), None, None), ("6", day(9), "n", 1)], "k string, at timestamp_ntz, name string, capacity int")
    args = (current, incoming, ["k"], "at", ["name", "capacity"])
    loose = {"capacity": F.col("k") == "3"}
    assert {r.k: r.outcome for r in ingest.scd2_outcomes(*args).collect()} == {"1": "changed", "2": "skipped_older", "3": "changed", "4": "unchanged", "5": "unchanged", "6": "new"}
    assert {r.k: r.outcome for r in ingest.scd2_outcomes(*args, loose).collect()}["3"] == "unchanged"
    rows = ingest.scd2_merge(*args, loose).collect()
    assert sorted((r.k, r.valid_from.day, r.valid_to and r.valid_to.day, r.capacity) for r in rows) == [("1", 5, 6, 4), ("1", 6, None, 4), ("2", 5, None, 4), ("3", 5, None, 4), ("4", 5, None, 4), ("5", 5, None, None), ("6", 9, None, 1), ("9", 1, None, 4)]


def test_second_level_stays_inside_the_first(spark):
    rows = spark.createDataFrame([(1, "東京都港区芝"), (2, "北海道港区"), (3, "京都府"), (4, None), (5, "東京都港南")], "id int, address string")
    first = spark.createDataFrame([(13, "東京都"), (1, "北海道"), (26, "京都府")], "code int, name string")
    second = spark.createDataFrame([(13, "13-港", "港"), (13, "13-港区", "港区"), (26, "26-港区", "港区")], "code int, sub_code string, sub_name string")
    got = {r.id: (r.code, r.sub_code) for r in reference.places(rows, "address", first, second, ["id"]).collect()}
    assert got == {1: (13, "13-港区"), 2: (1, None), 3: (26, None), 4: (None, None), 5: (13, "13-港")}
    old = spark.createDataFrame([(1, 13, "13-港区"), (2, 5, None)], "id int, code int, sub_code string")
    new = reference.places(rows, "address", first, second, ["id"])
    assert {r.id: r.outcome for r in keyed.rewritten(old, new, ["id"], ["code", "sub_code"]).collect()} == {1: "unchanged", 2: "changed", 3: "added", 4: "added", 5: "added"}


def test_windows_that_the_data_cannot_fill_are_errors(spark):
    days = spark.createDataFrame([(dt.date(2026, 1, d),) for d in range(1, 8)], "day date")
    parts = {r.day.day: (r.part, r.is_baseline) for r in sampling.split_days(days, 2, 1, 3).collect()}
    assert parts == {1: ("fit", False), 2: ("fit", True), 3: ("fit", True), 4: ("fit", True), 5: ("purge", False), 6: ("evaluate", False), 7: ("evaluate", False)}
    with pytest.raises(Exception, match="days are too few"):
        sampling.split_days(days, 6, 1).collect()
    with pytest.raises(ValueError, match="make no split"):
        sampling.split_days(days, 0)
    assert [r.present for r in sampling.window_days(days.where("day(day) <> 5"), "2026-01-07", 4).orderBy("day").collect()] == [True, False, True, True]
    with pytest.raises(Exception, match="last day 2026-01-08 is missing"):
        sampling.window_days(days, "2026-01-08", 4).collect()
    with pytest.raises(ValueError, match="off the grid"):
        timegrid.grid(spark, "2026-01-01 00:03:00", "2026-01-02 00:00:00", 5)
    with pytest.raises(ValueError, match="off the grid"):
        timegrid.entity_grid(days, "2026-01-01 00:00:00", "2026-01-02 00:07:00", 5)


def test_keep_windows(spark):
    now = F.to_timestamp_ntz(F.lit("2026-04-15 12:00:00"))
    at = lambda *a: dt.datetime(2026, *a)
    rows = [("infer", "ok", at(1, 16, 0)), ("infer", "ok", at(1, 15, 12)), ("infer", "ok", at(1, 15, 11)), ("infer", "failed", at(3, 16, 11)), ("load", "ok", at(3, 16, 12)), ("load", "ok", at(3, 16, 11))]
    df = spark.createDataFrame(rows, "job string, status string, at timestamp_ntz")
    kept = [r[0] for r in df.select(archive.kept_run("job", "status", "at", now, ("infer",))).collect()]
    assert kept == [True, True, False, False, True, False]
    # A month goes when its last moment is more than 60 days old: January on 1 April, not before.
    months = [r[0] for r in df.limit(1).select(*[]).crossJoin(spark.createDataFrame([(at(1, 31),), (at(2, 1),)], "at timestamp_ntz")).select(archive.kept_month("at", now)).collect()]
    assert months == [False, True]


def test_scratch_folders_are_new(spark):
    assert folder(spark, "x") != folder(spark, "x")
