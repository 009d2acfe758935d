"""Benchmark decontamination by winnowing.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, after
lower-casing A-Z. A window is ``span`` consecutive words of an item; an item of
fewer words, but not none, is one window of its own length. A document word is hit
when it lies in an occurrence of any window.

Fingerprints are hashes of ``k`` consecutive words; of every ``span - k + 1``
neighbouring hashes the smallest is kept (the rightmost of equal ones). Both sides
keep the same ones, so any shared run of ``span`` words shares a fingerprint. Items
of fewer than ``span`` words are looked up by their whole hash, one length at a
time. Documents that share a fingerprint are extended: every position of their text
is compared with the items' windows, which gives exact hits.

Two plans, equal in result. While the items' windows number at most
``max_windows`` (checked by a count), they are broadcast as sorted hash arrays and
one pass over the documents does it all, without a shuffle. Beyond that, winnowed
fingerprints of both sides are joined and only documents that share one are
extended, against all distinct windows by a second join.

Null or wordless texts have no words and no hits; repeated rows are rows like
others; extra columns may have any name (rows are carried whole; an own column of a
result's name gives way to it); an empty benchmark leaves all documents clean.
Items with a null item_id count in n_hit and contaminated, and are left out of
n_items, the digest and items, as they have no name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moorline.llm.shared import carried, carried_schema, cut, released
from moorline.llm.textarrays import ALNUM, as_long, ngram_hashes, row_ranges, slices, text_buffer, word_bounds, word_hashes


@dataclass(frozen=True)
class Params:
    span: int = 10  #: words in a window: shared runs of this length are always found
    k: int = 5  #: words in a fingerprint
    splits: int = 16  #: parts that a fingerprint or window of the shuffle plan is dealt over
    max_windows: int = 1_000_000  #: most item windows that are broadcast (about 100 bytes each on the driver, 24 in a task)

    @property
    def window(self) -> int:
        return self.span - self.k + 1


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, row of each word, word offsets of rows)."""
    data, offsets = text_buffer(column)
    starts, ends, rows = word_bounds(data, offsets, ALNUM)
    return word_hashes(data, starts, ends), rows, row_ranges(rows, len(offsets) - 1)


def winnow(grams: np.ndarray, whole: np.ndarray, window: int) -> np.ndarray:
    """Positions kept: the smallest hash of every run of ``window`` hashes that lies in one row, rightmost of equal ones.

    grams: hashes by position; whole: true where the gram lies in one row.
    """
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = grams[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, window):
        lower = grams[j : j + n] <= best
        best[lower] = grams[j : j + n][lower]
        at[lower] = j
    keep = np.arange(n) + at
    broken = np.cumsum(np.concatenate([[0], ~whole]))  # neighbouring grams that are whole lie in one row, as k > 1
    inside = broken[window : window + n] == broken[:n]
    return np.unique(keep[inside])


def item_windows(column: pa.Array, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of words, hash) of each distinct window of each item."""
    words, rows, at = _words(column)
    counts = np.diff(at)
    out = []
    if len(words) >= span:
        grams = ngram_hashes(words, span)
        whole = rows[: len(grams)] == rows[span - 1 :]
        out.append((rows[: len(grams)][whole], np.full(int(whole.sum()), span), grams[whole]))
    for n in range(1, span):
        short = np.flatnonzero(counts == n)
        if len(short):
            out.append((short, np.full(len(short), n), ngram_hashes(words, n)[at[short]]))
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keyed(items: DataFrame) -> DataFrame:
    """(item, item_id, text): item is never null for an item with words; items without an id are told apart by their text."""
    own = F.col("item_id").cast("string")
    return items.select(F.coalesce(F.concat(F.lit("i"), own), F.concat(F.lit("n"), F.sha2("text", 256))).alias("item"), own.alias("item_id"), "text")


def window_table(items: DataFrame, p: Params) -> DataFrame:
    """(item, item_id, n, window) of the keyed items: distinct windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, n, h = item_windows(part.column(2), p.span)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(n.astype(np.int32)), pa.array(as_long(h))], names=["item", "item_id", "n", "window"])

    return items.mapInArrow(run, "item string, item_id string, n int, window long").distinct()


def _fingerprints(batch_column: pa.Array, p: Params, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n, hash): winnowed k-gram hashes (n = k, told apart as 0) and all hashes of the short lengths asked for."""
    words, rows, _ = _words(batch_column)
    out = []
    if len(words) >= p.k:
        grams = ngram_hashes(words, p.k)
        whole = rows[: len(grams)] == rows[p.k - 1 :]
        kept = winnow(grams, whole, p.window)
        out.append((rows[kept], np.zeros(len(kept), dtype=np.int32), grams[kept]))
    for n in short:
        if len(words) >= n:
            grams = ngram_hashes(words, n)
            whole = rows[: len(grams)] == rows[n - 1 :]
            out.append((rows[: len(grams)][whole], np.full(int(whole.sum()), n, dtype=np.int32), grams[whole]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _member(sorted_hashes: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(x), dtype=bool)
    i = np.searchsorted(sorted_hashes, x)
    i[i == len(sorted_hashes)] = 0
    return sorted_hashes[i] == x


class _Extender:
    """Exact hits of one text among windows given as (lengths, sorted hashes, item numbers)."""

    def __init__(self, n: np.ndarray, h: np.ndarray, item: np.ndarray) -> None:
        self.by_length = {}
        for length in np.unique(n).tolist():
            mine = np.flatnonzero(n == length)
            mine = mine[np.argsort(h[mine], kind="stable")]
            self.by_length[length] = (h[mine], item[mine])

    def hits(self, words: np.ndarray) -> tuple[int, np.ndarray]:
        """(number of hit words, distinct item numbers)."""
        cover, items = np.zeros(len(words) + 1, dtype=np.int64), []
        for length, (h, item) in self.by_length.items():
            grams = ngram_hashes(words, length)
            found = np.flatnonzero(_member(h, grams))
            if len(found):
                np.add.at(cover, found, 1)
                np.add.at(cover, found + length, -1)
                low, high = np.searchsorted(h, grams[found], side="left"), np.searchsorted(h, grams[found], side="right")
                spans = np.unique(np.stack([low, high], axis=1), axis=0)
                items += [item[a:b] for a, b in spans.tolist()]
        return int((np.cumsum(cover) > 0).sum()), np.unique(np.concatenate(items)) if items else np.zeros(0, dtype=np.int64)


_HITS = "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, contaminated boolean"
_COLUMNS = ["n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"]
_NONE = hashlib.sha256(b"").hexdigest()


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _result(keys: list[pa.Array], key_names: list[str], n_words: np.ndarray, n_hit: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    cols = [pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in items], type=pa.int64()), pa.array([_digest(x) if x else _NONE for x in items]), pa.array(items, type=pa.list_(pa.string())), pa.array(n_hit > 0)]
    return pa.RecordBatch.from_arrays([*keys, *cols], names=[*key_names, *_COLUMNS])


def _one_pass(docs: DataFrame, windows: DataFrame, prints: DataFrame, p: Params) -> DataFrame:
    """Broadcast plan: the windows' number has been checked."""
    spark = docs.sparkSession
    rows = windows.select("item_id", "n", "window").orderBy("item_id", "n", "window").toPandas()
    names = sorted(set(rows.item_id.dropna()))
    number = {x: i for i, x in enumerate(names)}
    unnamed = len(names)  # the number of all items without an id
    kept = np.unique(prints.where("n = 0").select("print").distinct().toPandas()["print"].to_numpy(dtype=np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast((names, rows.n.to_numpy(dtype=np.int64), rows.window.to_numpy(dtype=np.int64).view(np.uint64), rows.item_id.map(number).fillna(unnamed).to_numpy(dtype=np.int64), kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, h, item, kept = shared.value
        extend = _Extender(n, h, item)
        short = {k: v[0] for k, v in extend.by_length.items() if k < p.span}
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field("text")], names=["own", "text"])
            for part in slices(batch, "text"):
                words, rows, at = _words(part.column(1))
                likely = np.zeros(part.num_rows, dtype=bool)
                if len(words) >= p.k and len(kept):
                    grams = ngram_hashes(words, p.k)
                    whole = rows[: len(grams)] == rows[p.k - 1 :]
                    own = winnow(grams, whole, p.window)
                    likely[rows[own[_member(kept, grams[own])]]] = True
                for length, known in short.items():
                    if len(words) >= length:
                        grams = ngram_hashes(words, length)
                        likely[rows[: len(grams)][_member(known, grams)]] = True
                n_hit, items = np.zeros(part.num_rows, dtype=np.int64), [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(likely):
                    n_hit[i], found = extend.hits(words[at[i] : at[i + 1]])
                    items[i] = [names[x] for x in found if x < len(names)]
                yield _result([part.column(0)], ["own"], np.diff(at), n_hit, items)

    return carried(docs).mapInArrow(run, carried_schema(docs, _HITS))


def _printer(p: Params, key: str, short: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, n, h = _fingerprints(part.column(1), p, short)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(n), pa.array(as_long(h))], names=[key, "n", "print"])

    return run


def _joined(docs: DataFrame, windows: DataFrame, prints: DataFrame, p: Params) -> DataFrame:
    """Shuffle plan: documents that share a fingerprint are extended against the distinct windows, whatever item they come from; items are attached to the windows hit.

    Fingerprints and windows that very many documents hold are dealt over ``splits`` parts,
    with a copy of the benchmark's side in each.
    """
    short = sorted(r.n for r in windows.where(F.col("n") < p.span).select("n").distinct().collect())  # span - 1 values at most
    keyed = cut(carried(docs).withColumn("row", F.monotonically_increasing_id()), "keyed")
    part = F.pmod(F.xxhash64("row"), F.lit(p.splits)).alias("part")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.splits - 1).cast("long"))).alias("part")
    own = keyed.select("row", F.col("own.text").alias("text")).mapInArrow(_printer(p, "row", short), "row long, n int, print long").distinct()
    wanted = prints.select("n", "print").distinct().select("n", "print", copies)
    rows = own.select("row", "n", "print", part).join(wanted, ["n", "print", "part"], "left_semi").select("row").distinct()
    words = keyed.select("row", F.col("own.text").alias("text")).join(rows, "row", "left_semi")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = [*short, p.span]
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, rows, at = _words(part.column(1))
                for n in lengths:
                    grams = ngram_hashes(hashes, n)
                    whole = np.flatnonzero(rows[: len(grams)] == rows[n - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
                    owner = rows[whole]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(np.full(len(whole), n, dtype=np.int32)), pa.array(as_long(grams[whole])), pa.array(whole - at[owner])], names=["row", "n", "window", "pos"])

    spots = words.mapInArrow(places, "row long, n int, window long, pos long").select("*", part)
    known = windows.select("n", "window").distinct().select("n", "window", copies)
    found = cut(spots.join(known, ["n", "window", "part"], "left_semi").drop("part"), "hits")
    before = F.max(F.col("pos") + F.col("n")).over(Window.partitionBy("row").orderBy("pos", "n").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("pos") + F.col("n") - F.greatest("pos", F.coalesce(before, "pos")), F.lit(0))
    hit = found.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    held = found.select("row", "n", "window").distinct().select("row", "n", "window", part)
    named = windows.where(F.col("item_id").isNotNull()).select("n", "window", "item_id").distinct().select("n", "window", "item_id", copies)
    items = held.join(named, ["n", "window", "part"]).select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([*batch.columns, batch.column(0).field("text")], names=["own", "row", "text"])
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(_words(part.column(2))[2]))], names=["own", "row", "n_words"])

    sized = keyed.mapInArrow(count, carried_schema(docs, "row long, n_words long"))
    out = sized.join(hit, "row", "left").join(items, "row", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("own", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), listed.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def judge(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """``own`` (each row of ``docs``, whole), n_words, n_hit, n_items, items_sha256, items (sorted ids), contaminated."""
    items = _keyed(items)
    windows = cut(window_table(items, p), "windows")
    lengths = list(range(1, p.span))
    prints = items.select("item", "text").mapInArrow(_printer(p, "item", []), "item string, n int, print long")
    prints = prints.unionByName(windows.where(F.col("n").isin(lengths)).select("item", "n", F.col("window").alias("print"))).distinct()
    plan = _one_pass if windows.count() <= p.max_windows else _joined
    return plan(docs, windows, prints, p)


def contamination(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """docs' columns without text, then n_words, n_hit, n_items, items_sha256, items (sorted ids), contaminated."""
    return released(judge(docs, items, p), _COLUMNS, without=("text",))
