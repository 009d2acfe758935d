"""Boosted forests with bounded leaves and rising columns, and scoring from a table of nodes.

**Training.** Columns are cut into bins once (quantiles; codes as they are; the last bin holds nulls). A level of a
tree is one aggregate: tasks add gradients and Hessians by (node, column, bin), Spark adds the tasks' sums, and
the driver, which sees nodes times columns times bins and no row, picks each node's best split. Leaves of most gain
are split first until the tree has ``leaves``. A side never holds fewer than ``least_leaf`` rows. Nulls of a number
go to the side that gains more; nulls and unknown codes of a category go right. Along a rising column the left value
never passes the right one: a split that would is refused, and both sides keep to their side of the middle from there on.

**Scoring.** A forest is a table: tree, node (0 the root), column, threshold, nan_left, codes, left, right, value. Any forest
in that form is walked by array functions in the JVM, without its trainer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "tree int, node int, column string, threshold double, nan_left boolean, codes array<int>, left int, right int, value double, gain double, n long"
NULL = 255  #: the bin of nulls and unknown codes


@dataclass(frozen=True)
class Params:
    trees: int = 20
    rate: float = 0.15
    leaves: int = 127
    least_leaf: int = 1000
    ridge: float = 10.0
    depth: int = 12
    bins: int = 64  #: of a number, below 255
    rising: tuple[str, ...] = ()  #: columns along which the score never falls


@dataclass
class Node:
    lower: float = -math.inf  #: bounds of the values below this node
    upper: float = math.inf
    value: float = 0.0
    n: int = 0
    column: int = -1
    bin_left: np.ndarray = field(default_factory=lambda: np.zeros(256, dtype=bool))  #: bins that go left
    threshold: float = 0.0
    nan_left: bool = False
    codes: list[int] | None = None
    left: int = -1
    right: int = -1
    gain: float = 0.0


@dataclass
class Forest:
    base: float  #: log odds before the first tree
    table: DataFrame  #: NODES
    depth: int  #: of the deepest tree

    def importance(self) -> DataFrame:
        """column, splits and gain."""
        return self.table.where("column is not null").groupBy("column").agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))


def edges(rows: DataFrame, numbers: list[str], bins: int) -> dict[str, np.ndarray]:
    """Upper edges of each number's bins, the last one open."""
    shares = [i / bins for i in range(1, bins)]
    if not numbers:
        return {}
    r = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in numbers]).first()
    return {c: np.unique(np.array(r[c] or [], dtype=float)) for c in numbers}


def _walk(bins: np.ndarray, tree: list[Node]) -> np.ndarray:
    """The node where each row stands, in a whole or half-grown tree."""
    at = np.zeros(len(bins), dtype=np.int64)
    for i, node in enumerate(tree):  # children come after their parents
        if node.left >= 0:
            here = np.flatnonzero(at == i)
            at[here] = np.where(node.bin_left[bins[here, node.column]], node.left, node.right)
    return at


def _sums(tree: list[Node], open_: list[int], n_columns: int):  # noqa: ANN202
    """A mapInArrow function: gradient, Hessian and rows by (node, column, bin) of the task's rows in open nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(tree), -1)
        place[open_] = np.arange(len(open_))
        total = np.zeros((3, len(open_) * n_columns * 256))
        for batch in batches:
            bins, y, w, margin = _columns(batch, n_columns)
            at = place[_walk(bins, tree)]
            keep = at >= 0
            bins, at = bins[keep], at[keep]
            p = 1 / (1 + np.exp(-margin[keep]))
            slot = ((at[:, None] * n_columns + np.arange(n_columns)) * 256 + bins).ravel()
            for k, v in enumerate((w[keep] * (p - y[keep]), w[keep] * p * (1 - p), np.ones(len(at)))):
                total[k] += np.bincount(slot, weights=np.repeat(v, n_columns), minlength=total.shape[1])
        cells = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(cells), *[pa.array(t[cells]) for t in total]], names=["cell", "g", "h", "n"])

    return run


def _columns(batch: pa.RecordBatch, n_columns: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, n_columns)
    return bins, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "margin"))


def _moved(tree: list[Node], n_columns: int):  # noqa: ANN202
    """A mapInArrow function: rows with the tree's value added to their margin."""
    values = np.array([n.value for n in tree])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, _, margin = _columns(batch, n_columns)
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), batch.column("w"), pa.array(margin + values[_walk(bins, tree)])], names=["bins", "y", "w", "margin"])

    return run


def _value(g: np.ndarray, h: np.ndarray, node: Node, p: Params) -> np.ndarray:
    return np.clip(-g / (h + p.ridge), node.lower, node.upper)


def _gain(g: np.ndarray, h: np.ndarray, v: np.ndarray, p: Params) -> np.ndarray:
    return -(2 * g * v + (h + p.ridge) * v * v)


def best_split(cells: np.ndarray, node: Node, columns: list[str], codes: dict[str, int], p: Params) -> tuple[float, int, np.ndarray, int, bool] | None:
    """(gain, column, bins to the left, last left bin, nulls left) of the best allowed split of a node's (3, columns, 256) sums."""
    best = None
    for c, name in enumerate(columns):
        g, h, n = cells[:, c]
        whole_g, whole_h, whole_n = g.sum(), h.sum(), n.sum()
        parent = _gain(whole_g, whole_h, _value(whole_g, whole_h, node, p), p)
        known = np.flatnonzero(n[:NULL])
        if name in codes:
            known = known[np.argsort(g[known] / (h[known] + p.ridge), kind="stable")]
        for nulls in (False, True) if name not in codes and n[NULL] else (False,):
            left = [np.cumsum(v[known]) + (v[NULL] if nulls else 0) for v in (g, h, n)]
            right = [whole_g - left[0], whole_h - left[1], whole_n - left[2]]
            lv, rv = _value(left[0], left[1], node, p), _value(right[0], right[1], node, p)
            gain = _gain(left[0], left[1], lv, p) + _gain(right[0], right[1], rv, p) - parent
            ok = (left[2] >= p.least_leaf) & (right[2] >= p.least_leaf)
            if name in p.rising:
                ok &= lv <= rv
            gain = np.where(ok, gain, -np.inf)
            if len(gain) and gain.max() > 1e-9 and (best is None or gain.max() > best[0] * (1 + 1e-12)):
                at = int(gain.argmax())
                to_left = np.zeros(256, dtype=bool)
                if name in codes:
                    to_left[known[: at + 1]] = True
                else:
                    to_left[: known[at] + 1] = True
                to_left[NULL] = nulls
                best = (float(gain.max()), c, to_left, int(known[at]), nulls)
    return best


def fit(rows: DataFrame, columns: list[str], y: str, w: str, written, p: Params = Params(), codes: dict[str, int] | None = None) -> Forest:  # noqa: ANN001
    """A forest for a 0/1 outcome. ``codes`` names the categories among ``columns`` and how many codes (from 0, below 255) each has; ``written(df, name)`` writes a table and reads it again."""
    codes = codes or {}
    spark, k = rows.sparkSession, len(columns)
    numbers = [c for c in columns if c not in codes]
    cuts = edges(rows, numbers, p.bins)
    total = rows.agg((F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("mean")).first()["mean"]
    mean = min(max(0.5 if total is None else float(total), 1e-6), 1 - 1e-6)
    base = math.log(mean / (1 - mean))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((batch.num_rows, k), NULL, dtype=np.uint8)
            for i, c in enumerate(columns):
                v = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(v) if c not in codes else (v >= 0) & (v < codes[c])
                out[known, i] = v[known].astype(np.uint8) if c in codes else np.searchsorted(cuts[c], v[known], side="left")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in out], pa.binary()), batch.column(k), batch.column(k + 1), pa.array(np.full(batch.num_rows, base))], names=["bins", "y", "w", "margin"])

    wanted = rows.where(F.col(y).isNotNull() & F.col(w).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(y).cast("double").alias("_y"), F.col(w).cast("double").alias("_w"))
    schema = "bins binary, y double, w double, margin double"
    state = written(wanted.mapInArrow(binned, schema), "binned")
    out, deepest = [], 0
    for number in range(p.trees):
        tree, open_, leaves, level = [Node()], [0], 1, 0
        while open_ and level <= p.depth:
            found = state.mapInArrow(_sums(tree, open_, k), "cell long, g double, h double, n double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas().sort_values("cell")
            cells = np.zeros((3, len(open_) * k * 256))
            cells[:, found["cell"].to_numpy(dtype=np.int64)] = found[["g", "h", "n"]].to_numpy().T
            cells = cells.reshape(3, len(open_), k, 256)
            splits = []
            for i, at in enumerate(open_):
                own, node = cells[:, i], tree[at]
                g, h, n = (v.sum() for v in own[:, 0])
                node.value, node.n = float(_value(g, h, node, p)), int(n)
                split = best_split(own, node, columns, codes, p) if level < p.depth else None
                if split:
                    splits.append((split, at, own))
            open_ = []
            for (gain, c, to_left, last, nulls), at, own in sorted(splits, key=lambda s: -s[0][0]):
                if leaves >= p.leaves:
                    break
                node, name = tree[at], columns[c]
                node.column, node.bin_left, node.gain, node.nan_left = c, to_left, gain, nulls
                if name in codes:
                    node.codes = np.flatnonzero(to_left[:NULL]).tolist()
                else:
                    node.threshold = float(cuts[name][last]) if last < len(cuts[name]) else math.inf
                left, right = Node(node.lower, node.upper), Node(node.lower, node.upper)
                if name in p.rising:
                    g, h = own[0, c], own[1, c]
                    middle = sum(float(_value(g[m].sum(), h[m].sum(), node, p)) for m in (to_left, ~to_left)) / 2
                    left.upper = right.lower = middle
                node.left, node.right = len(tree), len(tree) + 1
                open_ += [len(tree), len(tree) + 1]
                tree += [left, right]
                leaves += 1
            level += 1
        for node in tree:
            node.value *= p.rate
        deepest = max(deepest, level)
        out += [(number, i, columns[n.column] if n.left >= 0 else None, n.threshold if n.left >= 0 and n.codes is None else None, n.nan_left if n.left >= 0 else None, n.codes, n.left if n.left >= 0 else None, n.right if n.left >= 0 else None, n.value, n.gain, n.n) for i, n in enumerate(tree)]
        if number + 1 < p.trees:
            state = written(state.mapInArrow(_moved(tree, k), schema), "margins")
    return Forest(base, spark.createDataFrame(out, NODES), deepest)


def margin(columns: list[str], trees: Column, base: Column, depth: int) -> Column:
    """base plus the values of the leaves that a row comes to; a walk of ``depth`` steps that ends on no leaf is an error."""
    values = F.array(*[F.col(c).cast("double") for c in columns])

    def step(tree: Column, at: Column) -> Column:
        node = tree[at]
        v = F.get(values, node["index"])
        unknown = v.isNull() | F.isnan(v)
        left = F.when(node["codes"].isNotNull(), ~unknown & F.array_contains(node["codes"], v.cast("int"))).when(unknown, node["nan_left"]).otherwise(v <= node["threshold"])
        return F.when(node["left"].isNull(), at).when(F.coalesce(left, F.lit(False)), node["left"]).otherwise(node["right"])

    def leaf(tree: Column) -> Column:
        end = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), F.lit(0), lambda at, _: step(tree, at))
        return F.element_at(F.transform(F.array(end), lambda at: F.when(tree[at]["left"].isNull(), tree[at]["value"]).otherwise(F.raise_error(F.lit("a walk ended on no leaf")).cast("double"))), 1)

    return F.aggregate(trees, base.cast("double"), lambda sum_, tree: sum_ + leaf(tree))


def scored(rows: DataFrame, table: DataFrame, columns: list[str], depth: int, base: float = 0.0, name: str = "p_forest") -> DataFrame:
    """rows with the forest's probability. Nodes of a tree are numbered from 0 without gaps; the whole forest, whose size its makers bound, travels to every task."""
    index = (F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")) - 1).cast("int").alias("index")
    nodes = table.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("node", index, "threshold", "nan_left", "codes", "left", "right", "value"))).alias("nodes"))
    forest = nodes.agg(F.array_sort(F.collect_list(F.struct("tree", "nodes"))).alias("_f")).select(F.transform("_f", lambda t: t["nodes"]).alias("_forest"))
    out = rows.join(F.broadcast(forest))
    return out.withColumn(name, 1 / (1 + F.exp(-margin(columns, F.col("_forest"), F.lit(base), depth)))).drop("_forest")
