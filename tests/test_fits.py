"""Grouped fits, bounded forests and routing units against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moorline.operators import grouped, models, routing, trees
from moorline.plans.scratch import written


def plain_newton(x, y, w, ridge=1e-6):
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (w * (y - p)) - ridge * beta)
        beta = beta + step
    return beta


def test_three_systems_are_fitted_together(spark):
    """Coefficients and knots of three systems, and of a null one, equal a plain solver's on each alone."""
    rng = np.random.default_rng(1)
    rows = []
    for g, (system, slope) in enumerate([("a", 1.0), ("b", -0.5), ("c", 3.0), (None, 0.2)]):
        for _ in range(600):
            rate, port, kind = rng.uniform(0.02, 0.98), rng.uniform(0.1, 0.9), ["sat", "weekday"][rng.integers(2)]
            y = 1 / (1 + math.exp(-(slope * math.log(rate / (1 - rate)) + 0.3 * g + rng.normal() * 0.4)))
            rows.append((system, "bike", rate, port, kind, y, float(rng.integers(1, 9))))
    rows.append(("a", "bike", None, 0.5, "sat", 0.5, 1.0))
    df = spark.createDataFrame(rows, "system_id string, target string, rate double, port_rate double, dow_type string, y double, w double").repartition(4)
    fit = models.calibrate(df, ["system_id", "target"])
    table = {r.system_id: r.coefficients for r in fit.coefficients.collect()}
    scored = {(r.system_id, r.rate): r.p_trend for r in models.calibrated(df, fit).collect()}
    assert set(table) == {"a", "b", "c", None} and scored["a", None] is None
    logit = lambda p: np.log(p / (1 - p))
    for system, beta in table.items():
        own = [r for r in rows if r[0] == system and r[2] is not None]
        rate, port, y, w = (np.array([r[i] for r in own], dtype=float) for i in (2, 3, 5, 6))
        off = np.array([r[4] != "weekday" for r in own], dtype=float)
        x = np.column_stack([logit(rate), logit(port), off, off * logit(rate), off * logit(port)])
        want = plain_newton(x, y, w)
        assert np.allclose(beta, want, atol=1e-6)
        p = 1 / (1 + np.exp(-np.column_stack([np.ones(len(x)), x]) @ want))
        order = np.argsort(p)
        before = np.concatenate([[0.0], np.cumsum(w[order])[:-1]])
        b = np.minimum(np.floor(before * 1000 / w.sum()), 999)
        knots = [(np.average(p[order][b == k], weights=w[order][b == k]), np.average(y[order][b == k], weights=w[order][b == k]), w[order][b == k].sum()) for k in np.unique(b)]
        ys = grouped.pooled(np.array([k[1] for k in knots]), np.array([k[2] for k in knots]))
        assert (np.diff(ys) >= -1e-12).all()
        got = np.array([scored[system, r] for r in rate])
        assert np.allclose(got, np.interp(p, [k[0] for k in knots], ys), atol=1e-4)


def test_pooling_is_the_nearest_rising_sequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        y, w = rng.random(6), rng.integers(1, 5, 6).astype(float)
        got = grouped.pooled(y, w)
        # Every pooled value is the max over starts of the min over ends of the mean between them.
        want = [max(min(np.average(y[i : j + 1], weights=w[i : j + 1]) for j in range(k, 6)) for i in range(k + 1)) for k in range(6)]
        assert np.allclose(got, want)


def test_separable_and_empty_groups(spark):
    df = spark.createDataFrame([("s", float(x), int(x > 0), 1.0) for x in (-2, -1, 1, 2)] + [("none", None, 1, 1.0)], "g string, x double, y int, w double")
    got = {r.g: r.coefficients for r in grouped.logistic(df, ["g"], [F.col("x")], ridge=0.1).collect()}
    assert got["s"][1] > 0.5 and all(math.isfinite(v) for v in got["s"])
    assert grouped.logistic(df.where("false"), ["g"], [F.col("x")]).count() == 0


# Forests -----------------------------------------------------------------------------------


def forest_data(n=6000, seed=0):
    rng = np.random.default_rng(seed)
    x, z, c = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 6, n)
    p = 1 / (1 + np.exp(-(1.5 * x + np.where(np.isin(c, [1, 4]), 1.5, -1) + np.sin(2 * z))))
    y = rng.random(n) < p
    hole = rng.random(n)
    return [(None if hole[i] < 0.05 else float(x[i]), None if hole[i] > 0.97 else int(c[i]), float(z[i]), int(y[i]), float(1 + i % 3), i) for i in range(n)]


SCHEMA, COLUMNS, CODES = "x double, c int, z double, y int, w double, id int", ["x", "c", "z"], {"c": 6}


@pytest.fixture(scope="module")
def grown(spark):
    df = spark.createDataFrame(forest_data(), SCHEMA).cache()
    p = trees.Params(trees=6, rate=0.3, leaves=24, least_leaf=60, rising=("x",))
    return df, p, trees.fit(df.where("id % 3 > 0"), COLUMNS, "y", "w", written, p, CODES)


def walked(nodes, row):
    """The value of one tree for one row, step by step."""
    at = 0
    while nodes[at].column is not None:
        n, v = nodes[at], row[nodes[at].column]
        left = (v is not None and v in n.codes) if n.codes is not None else n.nan_left if v is None else v <= n.threshold
        at = n.left if left else n.right
    return nodes[at].value


def test_forest_keeps_its_bounds(spark, grown):
    df, p, forest = grown
    nodes = forest.table.collect()
    for t in range(p.trees):
        own = {n.node: n for n in nodes if n.tree == t}
        leaves = [n for n in own.values() if n.column is None]
        assert 2 <= len(leaves) <= p.leaves and min(n.n for n in leaves) >= p.least_leaf
        assert sum(n.n for n in leaves) == df.where("id % 3 > 0").count()
        assert all(own[n.left].n + own[n.right].n == n.n for n in own.values() if n.column is not None)
    # Scores of the table equal a walk in plain Python.
    by_tree = [{n.node: n for n in nodes if n.tree == t} for t in range(p.trees)]
    got = trees.scored(df, forest.table, COLUMNS, forest.depth, forest.base).collect()
    for r in got[::37]:
        margin = forest.base + sum(walked(t, r.asDict()) for t in by_tree)
        assert math.isclose(r.p_forest, 1 / (1 + math.exp(-margin)), rel_tol=1e-12)


def test_scores_never_fall_along_a_rising_column(spark, grown):
    _, _, forest = grown
    rng = random.Random(3)
    rows = [(k, x / 10, c, z) for k, (c, z) in enumerate((rng.choice([0, 1, 2, 3, 4, 5, None]), rng.gauss(0, 1)) for _ in range(40)) for x in range(-30, 31, 2)]
    df = spark.createDataFrame(rows, "k int, x double, c int, z double")
    got = {}
    for r in trees.scored(df, forest.table, COLUMNS, forest.depth, forest.base).orderBy("k", "x").collect():
        got.setdefault(r.k, []).append(r.p_forest)
    assert all(a <= b + 1e-12 for v in got.values() for a, b in zip(v, v[1:], strict=False))
    assert any(v[-1] - v[0] > 0.2 for v in got.values())


def test_bounded_forest_is_no_worse_than_mllibs(spark, grown):
    df, _, forest = grown
    other = models.forest_fit(df.where("id % 3 > 0"), COLUMNS, "y", "w", trees=6, rate=0.3, depth=5, categorical=CODES)
    brier = lambda d, c: d.agg(F.sum(F.col("w") * F.pow(F.col(c) - F.col("y"), 2)) / F.sum("w")).first()[0]
    held = df.where("id % 3 = 0")
    mine = brier(trees.scored(held, forest.table, COLUMNS, forest.depth, forest.base), "p_forest")
    assert mine <= brier(models.forest_score(held, other, COLUMNS, "p", CODES), "p") * 1.02 and mine < 0.2


def test_nulls_learn_their_side_and_first_split_is_best(spark):
    """Nulls go with the rows they resemble; the first split of a tree is the best of all, found by trying each."""
    rows = [(float(i % 50), int(i % 50 >= 30), 1.0) for i in range(1000)] + [(None, 1, 1.0)] * 100
    df = spark.createDataFrame(rows, "x double, y int, w double")
    p = trees.Params(trees=1, rate=1.0, leaves=2, least_leaf=10, ridge=1.0)
    forest = trees.fit(df, ["x"], "y", "w", written, p)
    root = forest.table.where("node = 0").first()
    assert root.threshold == 29.0 and root.nan_left is False
    mirrored = trees.fit(df.withColumn("y", 1 - F.col("y")).withColumn("x", -F.col("x")), ["x"], "y", "w", written, p)
    assert mirrored.table.where("node = 0").first().nan_left is True
    nothing = trees.fit(df.where("false"), ["x"], "y", "w", written, p)
    assert trees.scored(df.limit(1), nothing.table, ["x"], nothing.depth, nothing.base).first().p_forest == 0.5


# Routing -----------------------------------------------------------------------------------


def plain_routing(rows, cost):
    """(mode, unit) -> (mean gain, forest share), from loops over rows."""
    days = sorted({r["day"] for r in rows})
    modes = {"all": (rows, rows)}
    if len(days) > 1:
        modes["holdout"] = ([r for r in rows if r["day"] == days[0]], [r for r in rows if r["day"] != days[0]])
    brier = lambda own, c: sum(r["w"] * (r[c] - r["y"]) ** 2 for r in own) / sum(r["w"] for r in own)
    out = {}
    for mode, (choose, measure) in modes.items():
        def why(match, choose=choose):
            own = [r for r in choose if match(r)]
            if not own:
                return None, False
            b0, b3, bf = (brier(own, c) for c in ("p_b0", "p_b3", "p_forest"))
            if b0 < 0.001:
                return "excluded", False
            return "passed" if b3 > 0 and (b3 - bf) / b3 >= 0.1 else "below", bf > b3
        for unit in routing.UNITS:
            def to(r, unit=unit):
                horizon = lambda x: all(x[c] == r[c] for c in ("system_id", "target", "h_min"))
                cell = lambda x: horizon(x) and x["bucket"] == r["bucket"]
                if unit == "none":
                    return True
                if unit == "cell":
                    return why(cell)[0] == "passed"
                return why(cell)[0] is not None and why(horizon)[0] == "passed" and not why(cell)[1]
            flags = {}
            for r in measure:
                k = (r["system_id"], r["target"], r["h_min"], r["bucket"])
                if k not in flags:
                    flags[k] = to(r)
            gains, walked_, whole = [], 0.0, 0.0
            for g in sorted({(r["system_id"], r["target"]) for r in measure}):
                own = [{**r, "p": r["p_forest"] if flags[r["system_id"], r["target"], r["h_min"], r["bucket"]] else r["p_b3"]} for r in measure if (r["system_id"], r["target"]) == g]
                if brier(own, "p_b3") > 0:
                    gains.append(1 - brier(own, "p") / brier(own, "p_b3"))
            for r in measure:
                c = cost.get(r["system_id"], 1.0)
                whole += c
                walked_ += c * flags[r["system_id"], r["target"], r["h_min"], r["bucket"]]
            out[mode, unit] = (sum(gains) / len(gains) if gains else 0.0, walked_ / whole)
    return out


@pytest.mark.parametrize("days", [1, 3])
def test_units_and_holdout_equal_loops(spark, days):
    rng = random.Random(days)
    rows = []
    for _ in range(400):
        h, b, y = rng.choice([5, 60]), rng.randrange(4), rng.randrange(2)
        rows.append({"system_id": rng.choice("abc"), "target": rng.choice(["bike", "dock"]), "h_min": h, "bucket": b, "day": rng.randrange(days), "y": y, "w": float(rng.randrange(1, 5)), "p_b0": float(y) if h == 5 and b == 3 else rng.random(), "p_b3": min(1.0, max(0.0, 0.5 * y + 0.5 * rng.random())), "p_forest": min(1.0, max(0.0, (0.5 + 0.15 * b - 0.1) * y + 0.4 * rng.random()))})
    rows.append({**rows[0], "bucket": 5, "day": days - 1})  # a cell that the first day may not hold
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "system_id string, target string, h_min int, bucket int, day int, y int, w double, p_b0 double, p_b3 double, p_forest double")
    _, measured = routing.judge(df, {"a": 1.35})
    got = {(r["mode"], r["unit"]): (r["gain"], r["forest_share"]) for r in routing.summary(measured).collect()}
    want = plain_routing(rows, {"a": 1.35})
    assert set(got) == set(want) and len(got) == (3 if days == 1 else 6)
    assert all(math.isclose(x, y, abs_tol=1e-9) for k in want for x, y in zip(got[k], want[k], strict=True))


# Cells of a forest's rows -------------------------------------------------------------------


def test_cells_hold_all_weight_and_do_not_grow_with_rows(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(500)]), rng.randrange(4), rng.choice([None, 0, 1, 2]), int(rng.random() < 0.4), rng.randrange(1, 5)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "x int, h int, kind int, y int, w long")
    names = ["x", "h", "kind"]
    cells = models.forest_cells(df, names, "y", "w", {"kind": 3}, 32)
    held = cells.collect()
    xs = sorted({r.x for r in held if r.x is not None})
    assert xs[0] == 0 and 20 <= len(xs) <= 32 and {r.h for r in held} == {0, 1, 2, 3}
    part = lambda x: None if x is None else max(v for v in xs if v <= x)
    want = {}
    for x, h, k, y, w in rows:
        want[part(x), h, k, y] = want.get((part(x), h, k, y), 0) + w
    assert {(r.x, r.h, r.kind, r.y): r.w for r in held} == want
    assert models.forest_cells(df.union(df).union(df), names, "y", "w", {"kind": 3}, 32).count() == len(held)
    assert models.forest_cells(df.where("false"), names, "y", "w", {"kind": 3}).count() == 0


def test_a_forest_of_cells_is_the_forest_of_rows(spark):
    """Of numbers with few values nothing is cut: the sums of a tree over cells are those over rows."""
    rng = random.Random(12)
    rows = [(h := rng.randrange(6), k := rng.choice([None, 0, 1, 2]), int(rng.random() < 0.1 + 0.1 * h + 0.15 * (k == 1)), float(rng.randrange(1, 5))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "h int, kind int, y int, w double")
    names, codes = ["h", "kind"], {"kind": 3}
    fit = lambda x: models.forest_score(df, models.forest_fit(x, names, "y", "w", trees=3, depth=3, categorical=codes), names, "p", codes)
    score = lambda x: {(r.h, r.kind): r.p for r in fit(x).select("h", "kind", "p").distinct().collect()}
    a, b = score(df), score(models.forest_cells(df, names, "y", "w", codes))
    assert a.keys() == b.keys() and len(set(a.values())) > 4
    assert all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)
