"""Product codes of vectors by integer k-means, with Drake-Hamerly adaptive bounds.

Components become integers floor(scale * x), vectors are cut into ``parts`` equal parts, and
each part position has a codebook of ``entries`` integer entries, first those of the
smallest vec_ids. A round assigns every part to its nearest entry (ties to the lower index)
and replaces each entry by the floored mean of its parts; unused entries stay.

From the second assignment on, each part keeps, in a table written a round:

* an upper bound of the distance to its entry,
* its b closest other entries with a lower bound of the distance to each, in order,
* one outer bound below the distances to all others.

When entries move, the bounds move by as much. A part whose upper bound lies below all others
keeps its entry untouched. Otherwise its distance is computed exactly; if still undecided but below the
outer bound, the listed entries alone are computed; else all of them, and the list is made
anew. Every decision that the bounds (floats, with a slack) leave open is made on exact
integer distances, so codes, errors and codebooks equal the plain algorithm's. b adapts for each
position: the depth that all but ``shallow`` of the undecided parts needed, an eighth of the entries
at least.

Distances are integers: in floats while they are exact there (below 2**53), in Python integers
beyond. Sums of a batch's parts are added up by Spark as decimals; only codebooks and counts
of depths, whose size depends on entries and dimensions alone, reach the driver. Each round's
table replaces the one before, which is deleted once the next is written.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors shorter
than the longest, or whose length ``parts`` does not divide, count as if zeros followed. Integers beyond
1e24 in size count as that. Errors beyond the largest long are given as that. Null ids come
last in order; of rows with equal ids, the vectors decide. With fewer rows than entries, the
codebooks have as many entries as rows. Repeated rows each count. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.llm.shared import cut, dropped, written_at

NONE = 255  #: no entry at this place of a list
FARTHEST = 10**24
LONGEST = (1 << 63) - 1
EXACT = 1 << 53


@dataclass(frozen=True)
class Params:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: float = 4096.0
    shallow: float = 0.05  #: share of the undecided parts that may need all entries
    first_b: int = 4
    slack: float = 1e-9  #: by which bounds are widened


STATE = "vec_id long, label string, vector array<double>, code binary, upper array<double>, listed binary, lower array<double>, outer array<double>, error decimal(38,0)"
SUMS = "part int, entry int, n long, sums array<decimal(38,0)>, depths array<long>"


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): floats while all are below 2**53, else Python integers."""
    v = np.floor(vectors * scale)
    if np.all(np.abs(v) < EXACT):
        return v
    with np.errstate(over="ignore"):
        v = np.floor(np.clip(vectors, -FARTHEST, FARTHEST) * scale)
    whole = np.empty(v.shape, dtype=object)
    whole.ravel()[:] = [max(-FARTHEST, min(FARTHEST, int(x))) for x in v.ravel()]
    return whole


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, floats while they are exact there and Python integers beyond."""
    size = max([1, *(int(max(abs(a.min()), abs(a.max()))) for a in (x, entries) if a.size)])
    if x.dtype != object and entries.dtype != object and 4 * max(1, x.shape[1]) * size * size < EXACT:
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]
    x, entries = (a if a.dtype == object else np.array([[int(v) for v in r] for r in a], dtype=object).reshape(a.shape) for a in (x, entries))
    out = np.zeros((len(x), len(entries)), dtype=object)
    for j, e in enumerate(entries):
        d = x - e
        out[:, j] = (d * d).sum(1) if d.shape[1] else 0
    return out


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


class Bounds:
    """The bounds of one position's parts: assigned entry, upper bound, list of b entries with lower bounds, outer bound."""

    def __init__(self, code: np.ndarray, upper: np.ndarray, listed: np.ndarray, lower: np.ndarray, outer: np.ndarray) -> None:
        self.code, self.upper, self.listed, self.lower, self.outer = code, upper, listed, lower, outer

    @classmethod
    def fresh(cls, squares: np.ndarray, b: int) -> Bounds:
        """From exact distances to all entries."""
        n, k = squares.shape
        order = np.argsort(squares, axis=1, kind="stable")
        far = np.take_along_axis(roots(squares), order, axis=1)
        got = min(b, k - 1)
        listed, lower = np.full((n, b), NONE, dtype=np.uint8), np.full((n, b), np.inf)
        listed[:, :got], lower[:, :got] = order[:, 1 : 1 + got], far[:, 1 : 1 + got]
        outer = far[:, 1 + got] if k > 1 + got else np.full(n, np.inf)
        return cls(order[:, 0].astype(np.uint8), far[:, 0], listed, lower, outer)

    def take(self, rows: np.ndarray) -> Bounds:
        return Bounds(*(x[rows] for x in (self.code, self.upper, self.listed, self.lower, self.outer)))

    def put(self, rows: np.ndarray, new: Bounds) -> None:
        for name in ("code", "upper", "listed", "lower", "outer"):
            getattr(self, name)[rows] = getattr(new, name)

    def widened(self, b: int) -> Bounds:
        """With lists of b places: dropped entries fall under the outer bound, new places stay empty."""
        now = self.listed.shape[1]
        if b < now:
            outer = np.minimum(self.outer, self.lower[:, b:].min(axis=1))
            return Bounds(self.code, self.upper, self.listed[:, :b], self.lower[:, :b], outer)
        more = b - now
        return Bounds(self.code, self.upper, np.pad(self.listed, ((0, 0), (0, more)), constant_values=NONE), np.pad(self.lower, ((0, 0), (0, more)), constant_values=np.inf), self.outer)


def reassign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, held: Bounds, b: int, slack: float) -> tuple[Bounds, np.ndarray]:
    """Bounds after entries moved by ``moved`` (upper bounds), and how many parts needed each depth of list (the last: all entries)."""
    steps = np.append(moved, np.zeros(NONE + 1 - len(moved)))
    wide, thin = 1 + slack, 1 - slack
    upper = (held.upper + steps[held.code]) * wide
    lower = (held.lower - steps[held.listed]) * thin
    outer = (held.outer - moved.max(initial=0.0)) * thin
    out = Bounds(held.code.copy(), upper, held.listed.copy(), lower, outer)
    depths = np.zeros(out.listed.shape[1] + 2, dtype=np.int64)
    least = np.minimum(lower.min(axis=1, initial=np.inf), outer)
    open_ = np.flatnonzero(upper >= least)
    exact = np.zeros(len(x), dtype=object if x.dtype == object or entries.dtype == object else float)
    if len(open_):  # the exact distance to the own entry may settle it
        for j in np.unique(out.code[open_]):
            rows = open_[out.code[open_] == j]
            exact[rows] = distances(x[rows], entries[j : j + 1])[:, 0]
        out.upper[open_] = roots(exact[open_]) * wide
        settled = out.upper[open_] < least[open_]
        depths[0] += settled.sum()
        open_ = open_[~settled]
    inside = out.upper[open_] < out.outer[open_]
    few, all_ = open_[inside], open_[~inside]
    if len(few):
        got, used = _among_listed(x[few], entries, out.take(few), exact[few])
        out.put(few, got)
        np.add.at(depths, np.minimum(used, out.listed.shape[1]), 1)
    out = out.widened(b)
    if len(all_):
        out.put(all_, Bounds.fresh(distances(x[all_], entries), b))
        depths[-1] += len(all_)
    return out, depths


def _among_listed(x: np.ndarray, entries: np.ndarray, held: Bounds, own: np.ndarray) -> tuple[Bounds, np.ndarray]:
    """The nearest of the own entry and of those listed ones that the bounds leave open, and how many these are."""
    n, k, b = len(x), len(entries), held.listed.shape[1]
    at = np.arange(n)
    bounds = np.full((n, NONE + 1), np.inf)
    np.put_along_axis(bounds, held.listed.astype(np.int64), held.lower, axis=1)
    bounds = bounds[:, :k]
    near = bounds <= held.upper[:, None]
    best, least = held.code.astype(np.int64), own.copy()
    bounds[at, held.code] = roots(own)
    for j in range(k):
        rows = np.flatnonzero(near[:, j] & (held.code != j))
        if len(rows):
            d = distances(x[rows], entries[j : j + 1])[:, 0]
            bounds[rows, j] = roots(d)
            wins = np.array((d < least[rows]) | ((d == least[rows]) & (j < best[rows])), dtype=bool)
            best[rows[wins]], least[rows[wins]] = j, d[wins]
    upper = bounds[at, best]
    bounds[at, best] = np.inf
    order = np.argsort(bounds, axis=1, kind="stable")[:, :b]
    lower = np.take_along_axis(bounds, order, axis=1)
    listed = np.full((n, b), NONE, dtype=np.uint8)
    listed[:, : order.shape[1]][np.isfinite(lower)] = order[np.isfinite(lower)]
    lower = np.pad(lower, ((0, 0), (0, b - lower.shape[1])), constant_values=np.inf)
    return Bounds(best.astype(np.uint8), upper, listed, lower, held.outer), near.sum(axis=1)


@dataclass
class Round:
    """What every task of a round is given."""

    books: list[np.ndarray]  #: entries of each position
    moved: list[np.ndarray]  #: how far each entry moved, upper bounds; empty before the second assignment
    b: list[int]  #: list lengths of the bounds that are read
    next_b: list[int]  #: list lengths of the bounds that are written


def _assigned(r: Round, p: Params):  # noqa: ANN202
    """A mapInArrow function: state rows with new bounds, and each batch's sums, in one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.array(batch.column("vector").values.to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
            x = integers(vectors, p.scale)
            yield from _batch(batch, x, r, p)

    return run


def _batch(batch: pa.RecordBatch, x: np.ndarray, r: Round, p: Params) -> Iterator[pa.RecordBatch]:
    n, step = len(x), x.shape[1] // p.parts
    held = _read(batch, r.b) if r.moved else None
    new, sums, error = [], [], np.zeros(n, dtype=object)
    for i in range(p.parts):
        part, entries = x[:, i * step : (i + 1) * step], r.books[i]
        if held is None:
            got, depths = Bounds.fresh(distances(part, entries), r.next_b[i]), np.zeros(1, dtype=np.int64)
        else:
            got, depths = reassign(part, entries, r.moved[i], held[i], r.next_b[i], p.slack)
        new.append(got)
        for j in np.unique(got.code):
            rows = part[got.code == j]
            total = [int(v) for v in rows.sum(axis=0)] if len(rows) and (rows.dtype == object or np.abs(rows).max(initial=0) * len(rows) < EXACT) else [sum(int(v) for v in c) for c in rows.T]
            sums.append((i, int(j), len(rows), total, None))
            d = distances(rows, entries[j : j + 1])[:, 0]
            error[got.code == j] += np.array([int(v) for v in d], dtype=object)
        sums.append((i, -1, 0, None, depths.tolist()))
    state = {
        "kind": ["state"] * n,
        "vec_id": batch.column("vec_id"),
        "label": batch.column("label"),
        "vector": batch.column("vector"),
        "code": np.stack([b.code for b in new], axis=1).astype(np.uint8),
        "upper": np.stack([b.upper for b in new], axis=1),
        "listed": np.concatenate([b.listed for b in new], axis=1).astype(np.uint8),
        "lower": np.concatenate([b.lower for b in new], axis=1),
        "outer": np.stack([b.outer for b in new], axis=1),
        "error": pa.array([min(int(e), LONGEST + 1) for e in error], pa.decimal128(38, 0)),
    }
    for name in ("code", "listed"):
        state[name] = pa.array([row.tobytes() for row in state[name]], pa.binary())
    for name in ("upper", "lower", "outer"):
        flat = state[name]
        state[name] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
    yield _filled(state, n)
    each = list(zip(*sums, strict=True))
    yield _filled({"kind": ["sums"] * len(sums), "part": pa.array(each[0], pa.int32()), "entry": pa.array(each[1], pa.int32()), "n": pa.array(each[2], pa.int64()), "sums": pa.array(each[3], pa.list_(pa.decimal128(38, 0))), "depths": pa.array(each[4], pa.list_(pa.int64()))}, len(sums))


def _arrow_fields() -> list[tuple[str, pa.DataType]]:
    doubles = pa.list_(pa.float64())
    return [("kind", pa.string()), ("vec_id", pa.int64()), ("label", pa.string()), ("vector", doubles), ("code", pa.binary()), ("upper", doubles), ("listed", pa.binary()), ("lower", doubles), ("outer", doubles), ("error", pa.decimal128(38, 0)), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("depths", pa.list_(pa.int64()))]


def _filled(columns: dict, n: int) -> pa.RecordBatch:
    arrays = []
    for name, kind in _arrow_fields():
        value = columns.get(name)
        arrays.append(pa.nulls(n, kind) if value is None else value if isinstance(value, pa.Array) else pa.array(value, kind))
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in _arrow_fields()])


def _read(batch: pa.RecordBatch, b: list[int]) -> list[Bounds]:
    n = batch.num_rows
    flat = lambda name: np.array(batch.column(name).flatten().to_numpy(zero_copy_only=False)).reshape(n, -1)
    code, listed = (np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=np.uint8).reshape(n, -1) for name in ("code", "listed"))
    upper, lower, outer = flat("upper"), flat("lower"), flat("outer")
    ends = np.cumsum([0, *b])
    return [Bounds(code[:, i].copy(), upper[:, i], listed[:, ends[i] : ends[i + 1]], lower[:, ends[i] : ends[i + 1]], outer[:, i]) for i in range(len(b))]


def _whole(values: list[list[int]]) -> np.ndarray:
    """A codebook: floats while exact, else Python integers."""
    if all(abs(v) < EXACT for row in values for v in row):
        return np.array(values, dtype=float).reshape(len(values), -1)
    out = np.empty((len(values), len(values[0])), dtype=object)
    for i, row in enumerate(values):
        out[i, :] = row
    return out


def usable(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, vector) of the rows that are kept, as doubles of one length, and that length."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("vector"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) * parts
    if width:
        short = F.concat(F.col("vector"), F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector")))
        kept = kept.withColumn("vector", F.when(F.size("vector") == width, F.col("vector")).otherwise(short))
    return kept, width


@dataclass
class Codes:
    rows: DataFrame  #: vec_id, label, code (binary, one byte a part), error
    books: list[list[list[int]]]  #: final entries by part, entry, component
    open_share: list[float]  #: share of the parts that the bounds left open, each assignment from the second on


def fit(vectors: DataFrame, p: Params = Params()) -> Codes:
    """Codebooks after ``rounds`` rounds and every row's code and error."""
    spark = vectors.sparkSession
    kept, width = usable(vectors, p.parts)
    step = width // p.parts
    first = [integers(np.array([r.vector], dtype=float), p.scale)[0] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(p.entries).collect()]
    books = [[[int(v) for v in row[i * step : (i + 1) * step]] for row in first] for i in range(p.parts)]
    if not first:
        return Codes(kept.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("decimal(38,0)").alias("error")), books, [])
    least = max(1, p.entries // 8)
    now = Round([_whole(b) for b in books], [], [], [p.first_b] * p.parts)
    state, at, shares = cut(kept, "vectors"), None, []
    schema = f"kind string, {STATE}, {SUMS}"
    for turn in range(p.rounds + 1):
        out = state.mapInArrow(_assigned(now, p), schema)
        before, at = at, written_at(out, "codes", by="kind")
        table = spark.read.schema(schema).parquet(at)
        if before:
            dropped(spark, before)
        sums = table.where("kind = 'sums'")
        if turn:
            shares.append(_open(sums))
        if turn == p.rounds:
            break
        entries = sums.where("entry >= 0")
        counts = entries.groupBy("part", "entry").agg(F.sum("n").alias("n"))
        each = entries.select("part", "entry", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("v").alias("v"))
        n = {(r.part, r.entry): r.n for r in counts.collect()}
        new = [[list(e) for e in b] for b in books]
        for r in each.collect():
            new[r.part][r.entry][r.at] = int(r.v) // n[r.part, r.entry]
        moved = [np.array([_length(a, b) for a, b in zip(old, fresh, strict=True)]) * (1 + p.slack) for old, fresh in zip(books, new, strict=True)]
        depth = _depths(sums, p, now, least) if turn else list(now.next_b)
        books, now = new, Round([_whole(b) for b in new], moved, now.next_b, depth)
        state = table.where("kind = 'state'").select("vec_id", "label", "vector", "code", "upper", "listed", "lower", "outer")
    rows = table.where("kind = 'state'").select("vec_id", "label", "code", "error")
    return Codes(rows, books, shares)


def _length(a: list[int], b: list[int]) -> float:
    return float(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) ** 0.5


def _histogram(sums: DataFrame) -> dict[int, dict[int, int]]:
    """Of each position, how many parts needed each depth."""
    rows = sums.where("entry = -1").select("part", F.posexplode("depths").alias("depth", "n")).groupBy("part", "depth").agg(F.sum("n").alias("n")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r.part, {})[r.depth] = r.n
    return out


def _open(sums: DataFrame) -> float:
    """Share of the parts whose bounds did not settle them."""
    found = sum(n for h in _histogram(sums).values() for n in h.values())
    total = sums.where("entry >= 0").agg(F.sum("n")).first()[0] or 1
    return found / total


def _depths(sums: DataFrame, p: Params, now: Round, least: int) -> list[int]:
    """The next list lengths: what all but ``shallow`` of the undecided parts needed."""
    hist, out = _histogram(sums), []
    for i in range(p.parts):
        h = hist.get(i, {})
        width = now.b[i] + 1  # the last place of this round's histogram: parts that needed all entries
        total, run, need = sum(h.values()), 0, least
        for depth in range(width + 1):
            run += h.get(depth, 0)
            if run >= (1 - p.shallow) * total:
                need = depth if depth < width else min(p.entries - 1, now.next_b[i] * 2)
                break
        out.append(max(least, need))
    return out


def codebooks_sha256(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def compressed(vectors: DataFrame, p: Params = Params(), most_labels: int = 100_000) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of every kept row.

    The labels' sums are sent to every task while there are ``most_labels`` at most, else joined by a shuffle.
    """
    codes = fit(vectors, p)
    whole = lambda x: F.least(x, F.lit(LONGEST)).cast("long")
    rows = codes.rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.coalesce("label", F.lit("")).alias("l"), F.col("label").isNull().alias("none"))
    sums = cut(rows.groupBy("l", "none").agg(F.sum("error").alias("sum")), "labels")
    if sums.count() <= most_labels:
        sums = F.broadcast(sums)
    return rows.join(sums, ["l", "none"]).select("vec_id", "code", whole(F.col("error")).alias("error"), whole(F.col("sum")).alias("label_error"), F.lit(codebooks_sha256(codes.books)).alias("codebooks_sha256"))
