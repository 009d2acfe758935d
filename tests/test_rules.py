"""Rules of the engine on small hand-made tables, with the default constants."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from moorline.config import DEFAULT
from moorline.operators import archive, asof, build, calendars, evaluation, exclude, features, grouped, ingest, labels, models, monitors, reference, sampling, serving, timegrid
from moorline.sources import feeds, files

T0 = dt.datetime(2026, 9, 7, 0, 0)


def at(minutes, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def obs(spark, rows):
    """(station, observed minute, bikes, docks, flags, delay seconds)."""
    data = [("s", st, at(m), at(m, delay), b, k, f, 0) for st, m, b, k, f, delay in rows]
    return spark.createDataFrame(data, "system_id string, station_id string, observed_at timestamp_ntz, fetched_at timestamp_ntz, bikes int, docks int, flags int, reported_age_s int")


def points(spark, *rows):
    return spark.createDataFrame([("s", st, at(m, s)) for st, m, s in rows], "system_id string, station_id string, t timestamp_ntz")


def test_two_as_of_rules(spark):
    o = obs(spark, [("x", 0, 1, 1, 7, 40), ("x", 5, 2, 1, 7, 400), ("x", 6, 3, 1, 7, 10)])
    p = points(spark, ("x", 0, 39), ("x", 0, 40), ("x", 6, 0), ("x", 6, 10), ("x", 12, 0), ("y", 6, 0))
    seen = {(r.station_id, r.t): r.seen and r.seen.bikes for r in asof.as_of_feature(p, o, ["bikes"]).collect()}
    assert [seen["x", at(*k)] for k in ((0, 39), (0, 40), (6, 0), (6, 10), (12, 0))] == [None, 1, 1, 3, 3] and seen["y", at(6)] is None
    true = {r.t: r.truth and r.truth.bikes for r in asof.as_of_label(p.where("station_id = 'x'"), o, ["bikes"]).collect()}
    assert true[at(6)] == 3 and true[at(0, 39)] == 1


def test_as_of_ties_take_the_later_fetch(spark):
    o = obs(spark, [("x", 0, 1, 1, 7, 10), ("x", 0, 2, 1, 7, 20)])
    assert asof.as_of_feature(points(spark, ("x", 1, 0)), o, ["bikes"]).first().seen.bikes == 2
    assert asof.as_of_label(points(spark, ("x", 0, 0)), o, ["bikes"]).first().truth.bikes == 2


def test_labels_treat_missing_flags_as_unset(spark):
    df = spark.createDataFrame([(1, 7), (0, 7), (1, 5), (1, -1), (-1, 7)], "bikes int, flags int")
    assert [r[0] for r in df.select(labels.y_bike(F.col("bikes"), F.col("flags"))).collect()] == [1, 0, 0, 0, 0]


def test_base_reasons_in_order(spark):
    o = obs(spark, [("stale", 0, -1, 1, 1, 1), ("edge", 0, 1, 1, 7, 1), ("unseen", 9, 1, -1, 1, 1), ("off", 9, 1, 1, 3, 1), ("gone", 9, 1, 1, -1, 1), ("ok", 9, 1, 1, 7, 1)])
    p = points(spark, *[(s, 10, 0) for s in ("stale", "edge", "unseen", "off", "gone", "ok", "none")]).unionByName(points(spark, ("stale", 10, 1)))
    x = asof.as_of_feature(p, o, ["bikes", "docks", "flags"]).withColumn("r", exclude.base_reason("seen", "t", DEFAULT.staleness_s, F.col("station_id") == "gone"))
    got = {(r.station_id, r.t): r.r for r in x.collect()}
    assert got["stale", at(10)] == "unobserved_at_t" and got["stale", at(10, 1)] == "stale_at_t" and got["edge", at(10)] is None
    assert [got[s, at(10)] for s in ("unseen", "off", "gone", "none", "ok")] == ["unobserved_at_t", "suspended_at_t", "phantom", "no_asof_at_t", None]


def test_flow_window_is_half_open_and_skips_missing(spark):
    o = obs(spark, [("x", 0, 5, 0, 7, 1), ("x", 10, 3, 0, 7, 1), ("x", 20, -1, 0, 7, 1), ("x", 30, 4, 0, 7, 1), ("x", 70, 4, 0, 7, 1), ("x", 400, 4, 0, 7, 1), ("one", 0, 9, 0, 7, 1)])
    got = {(r.station_id, r.observed_at): (r.rentals, r.returns, r.n_changes, r.since_change_min) for r in features.flow(o, 60, 180).collect()}
    assert got["x", at(0)] == (0, 0, 0, None) and got["one", at(0)] == (0, 0, 0, None)
    assert got["x", at(30)] == (2, 1, 2, 0.0)
    assert got["x", at(70)] == (0, 1, 1, 40.0)  # the change at minute 10 is exactly 60 minutes ago
    assert got["x", at(400)] == (0, 0, 0, 180.0)


def test_lags_need_both_points_and_rolling_skips_invalid(spark):
    rows = [("s", "x", at(5 * i), b, b != 9) for i, b in enumerate([1, 9, 4, 6])]
    s = spark.createDataFrame(rows, "system_id string, station_id string, t timestamp_ntz, bikes int, valid boolean")
    x = features.rolling(features.lags(s, 5, (5, 10), (5, 15)), 5, 10).orderBy("t").collect()
    assert [r.lag_5 for r in x] == [None, None, None, 4] and [r.lag_10 for r in x] == [None, None, 1, None] and x[3].delta_15 == 5
    assert [r.roll_mean for r in x] == [1, 1, 2.5, 5]


def test_neighbours_and_empty_neighbourhoods(spark):
    st = spark.createDataFrame([("s", "a", 35.0, 139.0, False), ("s", "b", 35.002, 139.0, False), ("o", "c", 35.004, 139.0, False), ("s", "d", 35.001, 139.0, True), ("s", "far", 35.1, 139.0, False)], "system_id string, station_id string, lat double, lon double, geo_suspect boolean")
    e = reference.neighbours(st, 500.0)
    assert {(r.station_id, r.nb_station_id, r.distance_m, r.same_system) for r in e.collect()} == {("a", "b", 222, True), ("b", "a", 222, True), ("b", "c", 222, False), ("c", "b", 222, False), ("a", "c", 445, False), ("c", "a", 445, False)}
    s = spark.createDataFrame([("s", "a", at(0), 0, 4, 10), ("s", "b", at(0), -1, -1, 10), ("o", "c", at(0), 5, 5, None), ("s", "far", at(0), 1, 1, 2)], "system_id string, station_id string, t timestamp_ntz, bikes int, docks int, capacity int")
    x = {r.station_id: r for r in features.join_neighbours(s.select("system_id", "station_id", "t"), features.neighbour_sums(s, e, 300, 500)).collect()}
    assert (x["b"].nb_bikes, x["b"].nb_docks, x["b"].nb_empty, x["b"].nb_count, x["b"].nb_fill, x["b"].nb_bikes_same) == (5, 9, 1, 2, 0.0, 0)
    assert (x["far"].nb_bikes, x["far"].nb_count, x["far"].nb_fill) == (0, 0, None)


def test_weather_hours(spark):
    t = spark.createDataFrame([(at(60),), (at(61),), (at(89),), (at(90),)], "t timestamp_ntz")
    r = t.select(features.containing_hour(F.col("t")).alias("c"), features.nearest_hour(F.col("t")).alias("n")).collect()
    assert [x.c for x in r] == [at(60), at(120), at(120), at(120)] and [x.n for x in r] == [at(60), at(60), at(60), at(120)]


def test_calendar_kinds(spark):
    h = spark.createDataFrame([(dt.date(2026, 9, 21), "a"), (dt.date(2026, 9, 23), "b")], "date date, name string")
    c = {r.date.isoformat(): r for r in calendars.calendar(spark, "2026-08-10", "2027-01-05", h).collect()}
    assert c["2026-09-22"].day_type == "bridge" and c["2026-09-22"].dow_type == "weekday"
    assert [c[d].day_type for d in ("2026-08-13", "2026-08-17", "2026-12-29", "2027-01-03", "2026-09-21", "2026-09-20", "2026-09-19")] == ["obon", "weekday", "newyear", "newyear", "holiday", "sun", "sat"]
    assert c["2026-09-22"].is_day_before_holiday and c["2026-09-30"].is_last_business_day and c["2026-12-28"].is_last_business_day


def test_capacity_estimate_looks_at_calendar_days(spark):
    rows = [("s", "x", dt.date(2026, 9, d), c) for d, c in ((1, 50), (6, 10), (8, 12), (20, 3))]
    e = {r.day.day: (r.capacity_est, r.days_used) for r in reference.capacity_estimate(spark.createDataFrame(rows, "system_id string, station_id string, day date, capacity_max int")).collect()}
    assert e == {1: (50, 1), 6: (50, 2), 8: (12, 2), 20: (3, 1)}


def test_split_and_window(spark):
    days = spark.createDataFrame([(dt.date(2026, 9, d),) for d in range(1, 8)], "day date")
    assert [r.part for r in sampling.split_days(days, 2, 1).orderBy("day").collect()] == ["fit"] * 4 + ["purge"] + ["evaluate"] * 2
    w = sampling.window_days(days.where("day(day) <> 5"), "2026-09-07", 4).orderBy("day").collect()
    assert [(r.day.day, r.present) for r in w] == [(4, True), (5, False), (6, True), (7, True)]


def test_splitmix_matches_integers(spark):
    def mix(seed, n):
        m = (1 << 64) - 1
        z = (seed + n + 0x9E3779B97F4A7C15) & m
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & m
        return ((z ^ z >> 31) >> 11) / (1 << 53)

    states = [0, 5, -3, (1 << 62) + 12345, -(1 << 63), (1 << 63) - 1] + [k * 0x123456789ABCDEF % (1 << 63) for k in range(1, 200)]
    df = sampling.with_uniforms(spark.createDataFrame([(s,) for s in states], "s long"), [F.col("s"), sampling.wrapped_sum(F.col("s"), F.lit((1 << 63) - 1))], "u")
    got = {r.s: tuple(r.u) for r in df.collect()}
    assert all(u == (mix(s & ((1 << 64) - 1), 0), mix((s + (1 << 63) - 1) & ((1 << 64) - 1), 0)) for s, u in got.items())
    # the first number of the published generator from state 0 is 0xE220A8397B1DCDAF
    assert got[0][0] == (0xE220A8397B1DCDAF >> 11) / (1 << 53)


def test_pairs_are_drawn_by_day_entity_and_counter(spark):
    """Draws equal hand-worked ones, do not depend on other rows, and horizons of a point are drawn apart."""
    import hashlib

    rows = [(f"e{i}", dt.date(2024, 1, 1 + i % 3), g) for i in range(40) for g in range(24)]
    df = spark.createDataFrame(rows, "k string, day date, g int").repartition(5)
    draw = lambda x: {(r.k, r.day, r.g): r.d for r in sampling.with_draws(x, F.col("day"), [F.col("k")], F.col("g"), 10, 0.2, "d").collect()}
    got, m = draw(df), (1 << 64) - 1
    assert draw(df.where("g = 7 and k = 'e3'")).items() <= got.items()
    for (k, day, g), flags in got.items():
        seed = int(hashlib.md5(f"{day.isoformat()}|{k}".encode()).hexdigest()[:16], 16)
        for i, flag in enumerate(flags):
            z = (seed + g * 10 + i + 0x9E3779B97F4A7C15) & m
            z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & m
            z = ((z ^ z >> 27) * 0x94D049BB133111EB) & m
            assert flag == (((z ^ z >> 31) >> 11) / (1 << 53) < 0.2)
    sizes = [sum(f) for f in got.values()]
    assert abs(sum(sizes) / len(sizes) - 2) < 0.15 and len(set(sizes)) > 4


def _pools(points):
    """Weighted pool-adjacent-violators, in plain Python: [(x, y, w)] in order of x to fitted values."""
    blocks = []
    for _, y, w in points:
        blocks.append([y, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            y2, w2, n2 = blocks.pop()
            y1, w1, n1 = blocks.pop()
            blocks.append([(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [y for y, _, n in blocks for _ in range(n)]


def test_calibration_equals_brute_force(spark):
    """Logistic output, bins of equal weight, pooling and linear interpolation against plain loops."""
    import bisect
    import random

    rng = random.Random(8)
    data = []
    for _ in range(4000):
        rate, port = rng.uniform(0.02, 0.98), rng.uniform(0.1, 0.9)
        kind = rng.choice(["sat", "weekday", "sun_holiday"])
        data.append((rate, port, kind, int(rng.random() < 0.7 * rate + 0.1), float(rng.randrange(1, 9))))
    df = spark.createDataFrame(data, "rate double, port_rate double, dow_type string, y int, w double")
    fit = models.calibrate(df, [])
    got = models.calibrated(df, fit).select("rate", "p_trend").collect()
    raw = [(r.p, float(r.y), r.w) for r in grouped.predicted(df, fit.coefficients, [], models.calibration_features(), "p").select("p", "y", "w").collect()]
    values = {}
    for p, y, w in raw:
        v = values.setdefault(round(p * (1 << 20)), [0.0, 0.0, 0.0])
        v[0], v[1], v[2] = v[0] + w, v[1] + w * p, v[2] + w * y
    total, before, bins = sum(v[0] for v in values.values()), 0.0, {}
    for k in sorted(values):
        b = bins.setdefault(min(int(before * 1000 / total), 999), [0.0, 0.0, 0.0])
        for i in range(3):
            b[i] += values[k][i]
        before += values[k][0]
    points = [(b[1] / b[0], b[2] / b[0], b[0]) for _, b in sorted(bins.items())]
    assert len(points) > 900
    fitted, xs = _pools(points), [p[0] for p in points]

    def at(p):
        i = bisect.bisect_left(xs, p)
        if i == 0 or i == len(xs):
            return fitted[min(i, len(xs) - 1)]
        return fitted[i - 1] + (fitted[i] - fitted[i - 1]) * (p - xs[i - 1]) / (xs[i] - xs[i - 1])

    want = sorted((rate, at(p)) for (rate, *_), (p, _, _) in zip(data, raw, strict=True))
    assert all(math.isclose(a.p_trend, b, abs_tol=1e-6) for a, (_, b) in zip(sorted(got, key=lambda r: r.rate), want, strict=True))


def test_gate_lets_groups_fail(spark):
    """A calibrated group passes; one that is off by more than the bound, and one no better than its port mean, fail."""
    rows = []
    for target, shift, port in (("good", 0.0, 0.5), ("off", 0.1, 0.5), ("idle", 0.0, None)):
        for k in range(1, 10):
            p = k / 10
            for y, w in ((1, p), (0, 1 - p)):
                rows.append(("s", target, min(1.0, p + shift), p if port is None else port, y, w * 100))
    df = spark.createDataFrame(rows, "system_id string, target string, p double, port double, y int, w double")
    got = {r.target: r for r in models.trend_gate(df, "p", "port").collect()}
    assert {t: r.passes for t, r in got.items()} == {"good": True, "off": False, "idle": False}
    assert got["off"].ece > models.MOST_ECE and got["idle"].ece < models.MOST_ECE


def test_trend_rows_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    start, cols = dt.date(2024, 1, 1), ["n", "n_bike_ok", "n_dock_ok"]
    daily = []
    for d in range(40):
        kind = ("sat", "sun_holiday", "weekday", "weekday", "weekday", "weekday", "weekday")[d % 7]
        for st in "xy":
            for slot in range(4):
                if rng.random() < 0.8:
                    n = rng.randrange(2, 6)
                    daily.append(("s", st, start + dt.timedelta(d), kind, slot, n, rng.randrange(n + 1), rng.randrange(n + 1)))
    df = spark.createDataFrame(daily, "system_id string, station_id string, day date, dow_type string, slot15 int, n long, n_bike_ok long, n_dock_ok long")
    pairs = [(start + dt.timedelta(d), start + dt.timedelta(d - lag)) for d, lag in ((35, 2), (36, 2), (37, 7))]
    floors = {"weekday": 3, "sat": 2, "sun_holiday": 2}
    got = {(r.station_id, r.target, r.day, r.hour): (r.rate, r.port_rate, r.y, r.w) for r in models.trend_rows(df, spark.createDataFrame(pairs, "day date, edition date"), 14, 2, floors).collect()}
    want = {}
    for day, edition in pairs:
        inside = [x for x in daily if 0 <= (edition - x[2]).days < 14]
        for st in "xy":
            for hour in (0, 1):
                came = [x for x in daily if x[1] == st and x[2] == day and x[4] // 2 == hour]
                if not came:
                    continue
                own = [x for x in inside if x[1] == st and x[3] == came[0][3] and x[4] // 2 == hour]
                slots = {x[4]: sum(y[4] == x[4] for y in own) for x in own}
                if not slots or min(slots.values()) < floors[came[0][3]]:
                    continue
                port = [x for x in inside if x[1] == st]
                for target, c in (("bike", 6), ("dock", 7)):
                    rate = lambda rows: sum(x[c] for x in rows) / sum(x[5] for x in rows)  # noqa: B023, E731
                    want[st, target, day, hour] = (rate(own), rate(port), rate(came), float(sum(x[5] for x in came)))
    assert want and set(got) == set(want)
    assert all(math.isclose(a, b) for k in want for a, b in zip(got[k], want[k], strict=True))


def test_forest_splits_codes_by_subsets(spark):
    """Codes 0 and 3 against 1, 2 and null: one split of a tree of depth 1 tells them apart only where they are categories."""
    rows = [(c, int(c in (0, 3)), 1.0) for c in (0, 1, 2, 3, None) for _ in range(40)]
    df = spark.createDataFrame(rows, "c int, y int, w double")
    fit = lambda codes: {r.c: r.p for r in models.forest_score(df, models.forest_fit(df, ["c"], "y", "w", trees=1, depth=1, categorical=codes), ["c"], "p", codes).collect()}
    by_code, by_number = fit({"c": 4}), fit(None)
    assert min(by_code[0], by_code[3]) > 0.8 and max(by_code[1], by_code[2], by_code[None]) < 0.2
    assert max(by_number[1], by_number[2]) > 0.2


def test_ablation_interval_from_plain_draws(spark):
    """The bootstrap against a plain loop over repetitions with the same md5 draws, and a floor that the interval decides."""
    import hashlib

    ports = [("s", str(i), 1.0 + i % 3, 1.1 + (i * 7 % 5) / 10) for i in range(30)]
    got = evaluation.bootstrap(spark.createDataFrame(ports, "system_id string, station_id string, full double, ablated double"), 200).first()
    draws = []
    for rep in range(1, 201):
        up = down = 0.0
        for s, st, full, ablated in ports:
            u = (int(hashlib.md5(f"{s}|{st}|{rep}".encode()).hexdigest()[:8], 16) + 0.5) / (1 << 32)
            k, c = 0, math.exp(-1)
            while u >= c and k < 9:
                k += 1
                c += math.exp(-1) / math.factorial(k)
            up, down = up + k * (ablated - full), down + k * full
        draws.append(up / down)
    draws.sort()
    at = lambda q: draws[int(q * 199)] + (q * 199 - int(q * 199)) * (draws[int(q * 199) + 1] - draws[int(q * 199)])
    assert math.isclose(got.gain, sum(p[3] - p[2] for p in ports) / sum(p[2] for p in ports))
    assert math.isclose(got.low, at(0.025)) and math.isclose(got.high, at(0.975)) and got.low < got.gain < got.high
    m = spark.createDataFrame([(2, 0.5, 0.1, 4), (3, 0.5, -0.1, 4), (4, 0.5, 0.1, 4), (5, 0.5, 0.1, 3)], "k int, gain double, low double, n_not_worse int")
    assert evaluation.choose_floor(m, evaluation.helped()).first().floor == 4
    assert evaluation.choose_floor(m.where("k < 4"), evaluation.helped()).first().floor is None


def test_bad_feeds_are_quarantined(spark):
    good = '{"last_updated": 1788739200, "data": {"stations": [{"station_id": "a", "num_bikes_available": -2, "num_docks_available": 3, "is_renting": true, "last_reported": 1788739300}, {"station_id": "a", "num_bikes_available": 9, "num_docks_available": 3}]}}'
    rows = [(1, good), (2, "not json"), (3, '{"last_updated": 5, "data": {"stations": []}}'), (4, '{"last_updated": 1788739200, "data": {"stations": [{"station_id": "", "num_bikes_available": 99999, "num_docks_available": 1}]}}')]
    ok, bad = feeds.split(feeds.validate(spark.createDataFrame(rows, "k int, raw string")))
    assert [r.k for r in ok.collect()] == [1] and {r.k: len(r.issues) for r in bad.collect()} == {2: 2, 3: 1, 4: 2}
    rows, warn = feeds.normalise(feeds.explode_status(ok, ["k"]), ["k"])
    r, w = rows.collect(), warn.first()
    assert len(r) == 1 and (r[0].bikes, r[0].docks, r[0].flags, r[0].reported_age_s) == (0, 3, 2, 0)
    assert (w.conflicting_duplicates, w.clamped_age, w.clamped_negative) == (1, 1, 1)


def test_pack_refuses_doubled_ids_and_unpack_unequal_arrays(spark):
    ledger = spark.createDataFrame([("s", "a", 0), ("s", "b", 1)], "system_id string, station_id string, idx int")
    row = lambda st, b: ("s", st, at(0), b, 1, 7, 0)
    schema = "system_id string, station_id string, observed_at timestamp_ntz, bikes int, docks int, flags int, reported_age_s int"
    heads = spark.createDataFrame([("s", at(0))], "system_id string, observed_at timestamp_ntz")
    packed = ingest.pack(ledger, spark.createDataFrame([row("b", 4)], schema), heads)
    assert packed.first().bikes == [-1, 4]
    with pytest.raises(Exception, match="twice"):
        ingest.pack(ledger, spark.createDataFrame([row("b", 4), row("b", 5)], schema), heads).collect()
    with pytest.raises(Exception, match="unequal"):
        ingest.unpack(ledger, packed.withColumn("docks", F.slice("docks", 1, 1))).collect()


def test_latest_state_never_rolls_back(spark):
    state = spark.createDataFrame([("s", "a", at(10), 1, 1, 7, True, at(5)), ("s", "b", at(10), 2, 1, 7, True, at(5))], "system_id string, station_id string, observed_at timestamp_ntz, bikes int, docks int, flags int, is_present boolean, last_changed_at timestamp_ntz")
    snap = lambda m, b, odd=False: spark.createDataFrame([("s", "a", at(m), odd, b, 1, 7)], "system_id string, station_id string, observed_at timestamp_ntz, is_anomalous boolean, bikes int, docks int, flags int")
    get = lambda df: {r.station_id: (r.bikes, r.is_present, r.last_changed_at) for r in df.collect()}
    assert get(ingest.latest_state(state, snap(9, 5))) == {"a": (1, True, at(5)), "b": (2, True, at(5))}
    assert get(ingest.latest_state(state, snap(11, 1))) == {"a": (1, True, at(5)), "b": (2, False, at(11))}
    assert get(ingest.latest_state(state, snap(11, 5, True))) == {"a": (5, True, at(11)), "b": (2, True, at(5))}


def test_holiday_guards_and_weather_errors(spark):
    rows = spark.createDataFrame([(dt.date(2026, 1, 1), "x"), (dt.date(2026, 1, 1), "y")], "date date, name string")
    with pytest.raises(ValueError):
        files.check_holidays(rows, 1)
    raw = spark.createDataFrame([(at(0), '{"latitude": 35.0, "longitude": 139.0, "hourly": {"time": ["2026-09-07T09:00"], "precipitation": [1.0]}}')], "issued_hour timestamp_ntz, raw string")
    with pytest.raises(Exception, match="too short"):
        files.weather_batch(raw, "issued_hour", 0.05, 0.0625, 8, 9).collect()
    one = files.weather_batch(raw, "issued_hour", 0.05, 0.0625, 1, 9).first()
    assert (one.lat_idx, one.lon_idx, one.precip_mm) == (700, 2224, [1.0])


def test_holiday_csv_in_shift_jis(spark, tmp_path):
    (tmp_path / "h.csv").write_bytes("日付,名称\n2026/1/1,元日\n2026/1/12,成人の日\n".encode("shift_jis"))
    got = files.holidays_csv(spark, str(tmp_path / "h.csv"), least=2, known=["元日", "成人の日"]).orderBy("date").collect()
    assert [(r.date, r.name) for r in got] == [(dt.date(2026, 1, 1), "元日"), (dt.date(2026, 1, 12), "成人の日")]


def test_rerun_overwrites_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "a")
    o = obs(spark, [("x", 0, 1, 1, 7, 0), ("x", 65, 2, 1, 7, 0)])
    archive.write_hourly(o, path)
    archive.write_hourly(o.where("bikes = 2").withColumn("bikes", F.lit(9)), path)
    assert sorted(r.bikes for r in spark.read.parquet(path).collect()) == [1, 9]
    with pytest.raises(ValueError):
        archive.assert_columns(o, ["system_id"])


def test_roll_equals_sum(spark):
    cell = ("s", "x", "sat", 3)
    day = lambda n: spark.createDataFrame([(*cell, *[n] * 8)], "system_id string, station_id string, dow_type string, slot15 int, " + ", ".join(f"{c} long" for c in reference.SUMS))
    previous = reference.sum_dailies(day(1).unionByName(day(2)))
    rolled = reference.roll(previous, day(5), day(1)).first()
    assert (rolled.n_days, rolled.n) == (2, 7)
    assert reference.roll(reference.sum_dailies(day(1)), day(1).limit(0), day(1)).count() == 0


def test_serving_equals_training(spark, sf_dir):
    """The point build and the unsampled day build agree on every shared column; serving has every training row and more (those without a usable target)."""
    from moorline.plans import q_features as Q
    from moorline.plans import q_grid as G

    s = Q.sample_state(spark, sf_dir, sampled=False)
    x = Q.inputs(spark, sf_dir, s)
    t = "2024-01-22 00:00:00"
    day = Q.rounded(build.build_samples(s, x, sampled=False)).where(F.col("t") == t)
    now = Q.rounded(build.build_now(x, t, 1440))
    assert len(build.sample_columns(DEFAULT)) == 76
    assert day.columns == build.sample_columns(x.config) and now.columns == [c for c in day.columns if c not in build.LABEL_COLUMNS]
    rows = {(r.system_id, r.station_id, r.h_min): r for r in now.collect()}
    trained = day.collect()
    assert trained and len(rows) == now.count()
    for r in trained:
        mine = rows[r.system_id, r.station_id, r.h_min]
        assert all(r[c] == mine[c] for c in now.columns)
    # the other way: a serving row that training lacks has no usable outcome
    truth = asof.with_truth(now.withColumn("target", F.col("t") + timegrid.minutes(F.col("h_min"))), x.obs, ["bikes", "docks", "flags"], t="target")
    bad = truth.where("truth is null or truth.bikes = -1 or truth.docks = -1 or truth.observed_at < target - interval 1 day or truth.observed_at <= t")
    lost = {(r.system_id, r.station_id, r.h_min) for r in bad.collect()}
    assert set(rows) - {(r.system_id, r.station_id, r.h_min) for r in trained} <= lost


def test_no_feature_looks_ahead(spark, sf_dir):
    """Observations that arrive after t, weather issued after t and holidays aside, change no feature at t: counts, docks and flags of all later rows are altered."""
    import dataclasses

    from moorline.plans import q_features as Q

    x = Q.inputs(spark, sf_dir)
    t = "2024-01-20 00:00:00"
    after = F.col("fetched_at") > F.to_timestamp_ntz(F.lit(t))
    changed = x.obs.select(*[F.when(after, (F.col(c) + 3) % 7).otherwise(F.col(c)).cast("int").alias(c) if c in ("bikes", "docks", "flags", "reported_age_s") else F.col(c) for c in x.obs.columns])
    later_cells = x.cells.select(*[F.when(F.col("issued_hour") > F.to_timestamp_ntz(F.lit(t)), F.transform(c, lambda v: v + 100)).otherwise(F.col(c)).alias(c) if c in ("precip_mm", "temp_c", "wind_kmh") else F.col(c) for c in x.cells.columns])
    later_days = x.daily.select(*[F.when(F.col("day") >= "2024-01-20", F.col(c) * 2).otherwise(F.col(c)).alias(c) if c in features.SUMS else F.col(c) for c in x.daily.columns])
    later_max = x.capacities.withColumn("capacity_max", F.when(F.col("day") >= "2024-01-20", F.col("capacity_max") + 50).otherwise(F.col("capacity_max")))
    y = dataclasses.replace(x, obs=changed, cells=later_cells, daily=later_days, capacities=later_max)
    a, b = (sorted(map(str, Q.rounded(build.build_now(z, t, 1440)).collect())) for z in (x, y))
    assert a and a == b


def test_profile_edition_is_the_sum_of_its_days(spark):
    """Running sums that days enter and leave give each edition's plain sum, days without rows included."""
    import random

    rng = random.Random(4)
    start = dt.date(2024, 1, 1)
    daily = [("s", str(k), "sat", 0, start + dt.timedelta(days=d), *[rng.randrange(1, 9) for _ in features.SUMS]) for k in range(3) for d in range(60) if rng.random() < 0.4]
    df = spark.createDataFrame(daily, "system_id string, station_id string, dow_type string, slot15 int, day date, " + ", ".join(f"{c} long" for c in features.SUMS))
    asks = [("s", str(k), "sat", 0, start + dt.timedelta(days=d)) for k in range(4) for d in range(-2, 95)]
    got = features.with_profile(spark.createDataFrame(asks, "system_id string, station_id string, dow string, slot int, edition date"), df, 28, F.col("edition"), "slot", "dow")
    rows = got.collect()
    assert len(rows) == len(asks)
    for r in rows:
        own = [x for x in daily if x[1] == r.station_id and 0 <= (r.edition - x[4]).days < 28]
        assert r.prof_n_days == len(own)
        n = sum(x[5] for x in own)
        assert r.prof_p_bike is None if not own else math.isclose(r.prof_p_bike, sum(x[7] for x in own) / n)
        assert (r.prof_std is None) == (not own)


def test_reliability_ties_stay_together(spark):
    df = spark.createDataFrame([(p, 1, 1) for p in [100] * 50 + [200] * 3 + [300] * 7], "p1000 int, y int, w int")
    b = evaluation.reliability_quantile(df, [], 3).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in b] == [(0, 50), (2, 10)]
    assert evaluation.reliability(df, [], 20).orderBy("bin").first().bin == 2  # an edge belongs to the upper bin


def test_interpolation(spark):
    df = spark.createDataFrame([([5, 60], [100, 210], x) for x in (0, 5, 30, 60, 90)] + [([5], [100, 2], 5)], "h array<int>, p array<int>, x int")
    assert [r[0] for r in df.select(serving.interpolate(F.col("h"), F.col("p"), F.col("x"))).collect()] == [0.1, 0.1, 0.15, 0.21, 0.21, None]


def test_boxes():
    assert serving.snap_box(139.001, 35.0, 139.05, 35.019) == (139.0, 35.0, 139.05, 35.02)
    assert [serving.plan_of(0, 0, x, x) for x in (0.08, 0.09, 0.25, 0.5, 0.51)] == ["stations", "cells_0.01", "cells_0.01", "cells_0.05", "refuse"]


def test_box_refuses_too_many(spark):
    v = spark.createDataFrame([("s", str(i), 35.0, 139.0) for i in range(5)], "system_id string, station_id string, lat double, lon double")
    assert serving.query_box(v, 138, 34, 140, 36, 5).count() == 5
    with pytest.raises(Exception, match="too many"):
        serving.query_box(v, 138, 34, 140, 36, 4).collect()


def test_alerts_count_from_the_last_sent(spark):
    df = spark.createDataFrame([("k", at(m)) for m in (0, 30, 59, 60, 119, 121)], "k string, at timestamp_ntz")
    assert sorted(r.sent_at for r in monitors.suppress(df, "k", "at", 3600).collect()) == [at(0), at(60), at(121)]


def test_bootstrap_weights_are_poisson(spark):
    ports = spark.createDataFrame([("s", str(i), 1.0, 1.5) for i in range(200)], "system_id string, station_id string, full double, ablated double")
    r = evaluation.bootstrap(ports, 100).first()
    assert math.isclose(r.gain, 0.5) and math.isclose(r.low, 0.5) and r.reps == 100


def test_blend_finds_the_better_baseline(spark):
    rows = [(float(a), 0.5, 30, int(a > 0.5), 1) for a in [0.1, 0.2, 0.8, 0.9] * 50] + [(0.9, 0.5, 30, 0, 1), (0.1, 0.5, 30, 1, 1)] * 5
    df = spark.createDataFrame(rows, "p_b1 double, p_b2 double, h_min int, y int, w int")
    got = {r.p_b1: r.p_b3 for r in models.blend_predict(df, models.blend_fit(df)).collect()}
    assert got[0.9] > 0.85 and got[0.1] < 0.15


def test_x1000_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.0005,), (0.0015,), (-1.0,), (2.0,)], "p double")
    assert [r[0] for r in df.select(models.x1000(F.col("p"))).collect()] == [0, 2, 0, 1000]


def test_grid_floor_and_local_day(spark):
    df = spark.createDataFrame([(at(14 * 60 + 59),), (at(15 * 60 + 3),)], "t timestamp_ntz")
    r = df.select(timegrid.floor_to(F.col("t"), 5).alias("f"), timegrid.local_date(F.col("t"), 9).alias("d"), timegrid.minute_of_day(F.col("t"), 9).alias("m")).collect()
    assert [(x.f, x.d.day, x.m) for x in r] == [(at(14 * 60 + 55), 7, 1439), (at(900), 8, 3)]


def test_latest_stream_is_not_written_by_one_task(spark, sf_dir, monkeypatch):
    from moorline.plans import q_stream

    seen, laid = [], q_stream.stream_of

    def stream_of(spark, df, *more):
        seen.append(df)
        return laid(spark, df, *more)

    monkeypatch.setattr(q_stream, "stream_of", stream_of)
    assert q_stream.str_03_latest(spark, sf_dir).count() > 0
    assert "Repartition 1" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["str_01_feeds", "str_02_deduplicate", "str_03_latest", "str_04_hourly", "str_05_flow", "str_06_suppress"])
def test_streams_run_in_several_batches(spark, sf_dir, monkeypatch, name):
    import os

    from moorline.plans import q_stream

    paths, scratch = [], q_stream.I.scratch

    def noted(spark, n):
        paths.append(scratch(spark, n))
        return paths[-1]

    monkeypatch.setattr(q_stream.I, "scratch", noted)
    assert getattr(q_stream, name)(spark, sf_dir).count() > 0
    state = [p for p in paths if os.path.isdir(f"{p}/commits")]
    assert len(state) == 1 and len([f for f in os.listdir(f"{state[0]}/commits") if f.isdigit()]) >= 6


def test_folding_snapshots_equals_one_by_one(spark):
    """Many snapshots in one plan against the same fold in plain Python: absent, anomalous, unchanged, older than the state."""
    import random

    rng = random.Random(12)
    day = lambda d: at(d * 1440)
    snaps = [(s, d, rng.random() < 0.3) for s in ("s", "r") for d in range(2, 9)]
    rows = [(s, st, day(d), bad, rng.randrange(2), rng.randrange(2), 7) for s, d, bad in snaps for st in "abcd" if rng.random() < 0.6]
    seen = {(r[0], r[2]) for r in rows}
    snaps = [x for x in snaps if (x[0], day(x[1])) in seen]
    old = [("s", "a", day(1), 1, 1, 7, True, day(1)), ("s", "e", day(5), 0, 1, 7, True, day(5)), ("r", "b", day(20), 1, 0, 7, True, day(20)), ("q", "z", day(1), 1, 0, 7, False, day(1))]
    want = {(r[0], r[1]): list(r[2:]) for r in old}
    for s, d, bad in sorted(snaps, key=lambda x: x[1]):
        now = {r[1]: r[4:7] for r in rows if r[0] == s and r[2] == day(d)}
        for k in {k for k in want if k[0] == s} | {(s, st) for st in now}:
            here, have = k[1] in now, want.get(k)
            if have is None:
                want[k] = [day(d), *now[k[1]], True, day(d)]
            elif day(d) > have[0] and not (bad and not here):
                value = now[k[1]] if here else tuple(have[1:4])
                if (*value, here) != tuple(have[1:5]):
                    want[k] = [day(d), *value, here, day(d)]
    state = spark.createDataFrame(old, "system_id string, station_id string, observed_at timestamp_ntz, bikes int, docks int, flags int, is_present boolean, last_changed_at timestamp_ntz")
    new = spark.createDataFrame(rows, "system_id string, station_id string, observed_at timestamp_ntz, is_anomalous boolean, bikes int, docks int, flags int")
    got = {(r.system_id, r.station_id): list(r[2:]) for r in ingest.fold_snapshots(state, new).collect()}
    assert got == want
    assert {(r.system_id, r.station_id): list(r[2:]) for r in ingest.fold_snapshots(state, new.limit(0)).collect()} == {(r[0], r[1]): list(r[2:]) for r in old}


def test_versions_meet_points_once(spark):
    h = spark.createDataFrame([("k", at(0), at(10), "a"), ("k", at(10), at(10), "b"), ("k", at(10), at(30), "c"), ("k", at(40), None, "d"), ("j", at(5), at(6), "e")], "k string, valid_from timestamp_ntz, valid_to timestamp_ntz, v string")
    p = spark.createDataFrame([("k", at(m), m) for m in (-1, 0, 9, 10, 29, 30, 39, 40, 99)] + [("j", at(5), 5), ("j", at(6), 6), ("i", at(6), 6)], "k string, t timestamp_ntz, m int")
    got = {(r.k, r.m): r.v for r in ingest.at_time(p, h, ["k"], "t").collect()}
    assert got == {("k", 0): "a", ("k", 9): "a", ("k", 10): "c", ("k", 29): "c", ("k", 40): "d", ("k", 99): "d", ("j", 5): "e"}


def test_suppression_over_batches(spark):
    """Many alerts of few keys, in Arrow batches smaller than a key's rows, against a plain loop."""
    import random

    rng = random.Random(1)
    rows = [(k, at(rng.randrange(5000), rng.randrange(60))) for k in "abc" for _ in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = sorted((r.k, r.sent_at) for r in monitors.suppress(spark.createDataFrame(rows, "k string, at timestamp_ntz"), "k", "at", 3600).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = [], {}
    for k, t in sorted(rows):
        if k not in last or (t - last[k]).total_seconds() >= 3600:
            want.append((k, t))
            last[k] = t
    assert got == want


def test_a_score_of_thousandths_is_the_same_in_any_order_of_its_rows(spark):
    """Sixteen errors whose mean is a tie at nine digits: in floats it falls to either side as the rows stand."""
    rows = [(137, 0), (261, 0), (507, 1), (483, 1), (807, 0), (96, 1), (29, 1), (443, 0), (712, 1), (272, 0), (605, 0), (923, 1), (31, 0), (26, 0), (961, 1), (702, 0)]
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "p int, y int").coalesce(1)
        assert df.agg(F.round(evaluation.brier_x1000(F.col("p"), F.col("y")), 9)).first()[0] == 0.264351688
    assert spark.createDataFrame([(None, 1)], "p int, y int").agg(evaluation.brier_x1000(F.col("p"), F.col("y"))).first()[0] is None
