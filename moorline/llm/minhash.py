"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

A document's set is its distinct word shingles (``k`` words; ASCII lower-cased;
words are runs without ASCII white space). With fewer than k words the whole
sequence is its one shingle; without words or with null text the set is empty and
linked with nothing. Two documents are linked when 100 * |A & B| >= percent * |A | B|.

Steps, each a Spark job over all rows:

1. one pass over the texts makes set size, a 128-bit set hash, a SuperMinHash
   signature and its band keys (no text leaves the pass);
2. documents with equal sets fold into one class by a partial aggregate; a class has
   a number of its own, the smallest doc_id of its rows, and one row whose text speaks
   for it;
3. band keys shared by two or more classes give candidates. Small buckets yield all
   their pairs. In a large bucket every member meets the bucket's most central
   members (those that share most buckets), chosen by partial aggregates, so that a
   group of n copies costs about n pairs;
4. candidates are confirmed on the full shingle sets, rebuilt from the texts. Only the
   texts of candidate classes are shuffled: a bitmap of fixed greatest size drops the
   others in the scan. A class in many pairs has its text copied once for every
   ``share`` of them, so no task holds all pairs of one class;
5. links become components by distributed union-find. The members of large buckets that
   still hold more than one component are compared by their rarest shingles: in one
   fixed order, rarest first, two sets of the wanted similarity share a shingle within
   the first quarter of each (no such pair is lost, and texts that share only a common
   passage meet nowhere). A longer sketch then decides which of these pairs are worth
   confirming, and components are rebuilt.

Repeated rows are documents like others (equal sets, one class). Rows are linked by
their own texts, never by their ids: rows that repeat an id with another text belong to
the classes of their texts, and rows with a null doc_id link like others (their
component_id is the smallest id reachable, null where there is none, and kept is
false). Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.llm.components import connected_components
from moorline.llm.shared import cut
from moorline.llm.textarrays import SPACE, as_long, mix, ngram_hashes, row_ranges, slices, text_buffer, word_bounds, word_hashes


@dataclass(frozen=True)
class Params:
    """Bands are cut from ``bands`` x ``rows`` signature values. At similarity 0.75, 32 bands of 4 miss a pair with odds of 5e-6."""

    k: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    small_bucket: int = 10  #: buckets up to this size yield all their pairs
    pivots: int = 4  #: central members that each member of a larger bucket meets
    share: int = 256  #: pairs that one copy of a class's text serves
    bitmap_bits: int = 1 << 27  #: most bits of the bitmap of candidate classes (16 MB)
    places: int = 1 << 20  #: counters of the last step, by which shingles are ordered; any number gives the same links
    deal: int = 1024  #: members of one shingle that one task compares with the others
    fine: int = 512  #: sketch slots of the last step
    slack: float = 0.1  #: how far below the threshold a sketch's estimate may lie and still be confirmed (5.2 standard errors)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, row of each) of a slice of texts."""
    data, offsets = text_buffer(column)
    n_rows = len(offsets) - 1
    starts, ends, rows = word_bounds(data, offsets, SPACE)
    words = word_hashes(data, starts, ends)
    at = row_ranges(rows, n_rows)
    grams = ngram_hashes(words, k)
    whole = rows[: len(grams)] == rows[k - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    hashes, owner = [grams[whole]], [rows[: len(grams)][whole]]
    counts = np.diff(at)
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            hashes.append(ngram_hashes(words, n)[at[short]])
            owner.append(short)
    h, o = np.concatenate(hashes), np.concatenate(owner)
    if len(hashes[0]) < len(h):
        order = np.argsort(o, kind="stable")
        h, o = h[order], o[order]
    ends = row_ranges(o, n_rows)
    for i in np.flatnonzero(np.diff(ends) > 1):
        h[ends[i] : ends[i + 1]].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


def superminhash(h: np.ndarray, owner: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """SuperMinHash signatures, n_rows x m floats (inf for empty sets).

    Element d draws, step by step, r_j in [0, 1) and the next place p_j of its own
    random permutation; slot i holds the minimum over elements of r_j + j where
    p_j = i. Steps end for a document as soon as no slot can still fall, which for
    sets much larger than m is after the first. All elements of a slice take a step
    together; permutations are kept only for documents that need a second step.
    """
    sig = np.full(n_rows * m, np.inf)
    row, key, perm, ids = owner, h, None, None
    j = 0
    while len(row) and j < m:
        draw = mix(key + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r = (draw >> np.uint64(11)).astype(np.float64) / (1 << 53)
        place = j + ((mix(draw ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = place
        else:
            slot = perm[ids, place].astype(np.int64)
            perm[ids, place] = perm[ids, j]
        np.minimum.at(sig, row * m + slot, r + j)
        worst = sig.reshape(n_rows, m).max(axis=1)
        alive = worst[row] >= j + 1
        if j == 0 and alive.any():
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (int(alive.sum()), 1))
            first = place[alive]
            ids = np.arange(len(first))
            perm[ids, first] = perm[ids, 0]
        elif perm is not None:
            ids = ids[alive]
        row, key = row[alive], key[alive]
        j += 1
    return sig.reshape(n_rows, m)


_SIGNED = "doc_id long, text_a long, text_b long, n_shingles long, set_a long, set_b long, bands array<long>"


def _signer(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n = part.num_rows
                h, owner = shingle_sets(part.column(1), p.k)
                size = np.bincount(owner, minlength=n)
                sig = superminhash(h, owner, n, p.bands * p.rows)
                at = row_ranges(owner, n)
                sums = np.zeros((2, len(h) + 1), dtype=np.uint64)
                np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=sums[0, 1:])
                np.cumsum(mix(h ^ np.uint64(0x14057B7EF767814F)), out=sums[1, 1:])
                a, b = (s[at[1:]] - s[at[:-1]] for s in sums)
                bits = mix(sig.view(np.uint64))
                bands = np.full((n, p.bands), 0, dtype=np.uint64)
                for j in range(p.rows):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + bits[:, j :: p.rows])
                bands = mix(bands + np.arange(p.bands, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        part.column(3),
                        pa.array(size.astype(np.int64)),
                        pa.array(as_long(a)),
                        pa.array(as_long(b)),
                        pa.ListArray.from_arrays(np.arange(0, n * p.bands + 1, p.bands, dtype=np.int32), pa.array(as_long(bands.ravel()))),
                    ],
                    names=["doc_id", "text_a", "text_b", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def _verifier(p: Params):
    def sets(column: pa.Array) -> list[np.ndarray]:
        h, owner = shingle_sets(column, p.k)
        at = row_ranges(owner, len(column))
        return [h[at[i] : at[i + 1]] for i in range(len(column))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_u"):
                keep = []
                left, at = sets(part.column(2)), 0
                for half in slices(part, "text_v"):
                    for i, y in enumerate(sets(half.column(3)), start=at):
                        x = left[i]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if both and 100 * both >= p.percent * (len(x) + len(y) - both):
                            keep.append(i)
                    at += half.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, type=pa.int64())), part.column(1).take(pa.array(keep, type=pa.int64()))], names=["u", "v"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit("b"), "text").alias("text_b"))


def _bit(p_bits: int) -> Column:
    """Place of a (text_a, text_b, doc_id) in a bitmap, from 1."""
    return F.pmod(F.xxhash64("text_a", "text_b", "doc_id"), F.lit(p_bits)) + 1


def class_texts(ids: DataFrame, classes: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """(*ids' columns, text): the text of each class of ``ids(id, ...)``. Only texts that a bitmap of the wanted classes lets pass are shuffled."""
    key = ["text_a", "text_b", "doc_id"]
    wanted = cut(ids.join(classes.select("id", F.col("speaks.*")), "id"), "wanted")
    bits = min(p.bitmap_bits, 1 << max(15, (16 * wanted.count()).bit_length()))
    at = _bit(bits)
    bitmap = wanted.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    texts = _keyed(docs).withColumn("bucket", F.bitmap_bucket_number(at)).withColumn("place", F.bitmap_bit_position(at))
    texts = texts.join(F.broadcast(bitmap), "bucket")  # at most bits / 8 bytes
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    texts = texts.where(F.getbit(byte, F.col("place") % 8) == 1).select("doc_id", "text", "text_a", "text_b").dropDuplicates(key)
    own = texts.select(*[F.col(c).alias(f"t_{c}") for c in key], "text")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    return wanted.hint("merge").join(own, same).select(*ids.columns, "text")


def _dealt(pairs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """``pairs(u, v)`` with the copy of each end that serves them, and the copies (id, end, part) that are asked for."""
    asked = []
    for end, other in (("u", "v"), ("v", "u")):
        copies = pairs.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / p.share).alias("copies"))
        pairs = pairs.join(copies, end).withColumn(f"{end}_part", F.pmod(F.xxhash64(other), "copies")).drop("copies")
        asked.append(copies.select(F.col(end).alias("id"), F.lit(end).alias("end"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("part")))
    return pairs, asked[0].unionByName(asked[1])


def _met(pairs: DataFrame, held: DataFrame, value: str) -> DataFrame:
    """(u, v, value_u, value_v) of dealt pairs, from ``held(id, end, part, value)``."""
    for end in ("u", "v"):
        own = held.where(F.col("end") == end).select(F.col("id").alias(end), F.col("part").alias(f"{end}_part"), F.col(value).alias(f"{value}_{end}"))
        pairs = pairs.join(own, [end, f"{end}_part"])
    return pairs.select("u", "v", f"{value}_u", f"{value}_v")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """Those of ``pairs(u, v)`` of classes whose full shingle sets are similar enough."""
    pairs, asked = _dealt(pairs, p)
    texts = cut(class_texts(asked, classes, docs, p), "texts")
    return _met(pairs, texts, "text").mapInArrow(_verifier(p), "u long, v long")


def _alike(a: Column, b: Column, p: Params) -> Column:
    """Set sizes that allow the wanted similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * p.percent


def _fine(p: Params):
    """Longer sketches of the few documents that the last step compares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 16):
                h, owner = shingle_sets(part.column(1), p.k)
                bits = mix(superminhash(h, owner, part.num_rows, p.fine).view(np.uint64))
                sketch = (bits & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sketch], type=pa.binary())], names=["id", "sketch"])

    return run


def _looker(p: Params):
    """Pairs whose sketches agree in nearly enough slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                near = pa.array((a == b).mean(axis=1) >= p.percent / 100 - p.slack)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["u", "v"])

    return run


def _place(h: np.ndarray, p: Params) -> np.ndarray:
    return (mix(h) % np.uint64(p.places)).astype(np.int64)


def _counter(p: Params):
    """Shingles at each place of the counters, summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.places, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                h, _ = shingle_sets(part.column(0), p.k)
                np.add.at(total, _place(h, p), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["place", "n"])

    return run


def _levels(texts: DataFrame, p: Params) -> np.ndarray:
    """How common the shingles of each place are: 1 for a single one, then four levels for each doubling. One byte a place."""
    counts = texts.select("text").mapInArrow(_counter(p), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # at most p.places rows
    levels = np.zeros(p.places, dtype=np.uint8)
    levels[counts.column("place").to_numpy()] = 1 + np.floor(4 * np.log2(counts.column("n").to_numpy()))
    return levels


def _prefixer(levels: np.ndarray, p: Params):
    """The rarest shingles of each set, with their ranks.

    Sets of sizes n <= m and the wanted similarity share at least percent / (100 + percent) * (n + m)
    shingles. Their first common one therefore stands among the first n - percent / 100 * n + 1 of
    either set, and, in the smaller one, among the first n - 2 * percent / (100 + percent) * n + 1
    (``leads``). A shingle that no other open text has is ranked but not emitted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                h, owner = shingle_sets(part.column(2), p.k)
                level = levels[_place(h, p)]
                order = np.lexsort((h, level, owner))
                h, level = h[order], level[order]
                at = row_ranges(owner, part.num_rows)
                n = np.diff(at)[owner]
                rank = np.arange(len(h)) - at[owner]
                keep = (rank * 100 <= n * (100 - p.percent)) & (level > 1)
                leads = rank * (100 + p.percent) <= n * (100 - p.percent)
                rows = pa.array(owner[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(h[keep])), part.column(0).take(rows), part.column(1).take(rows), pa.array(n[keep]), pa.array(rank[keep]), pa.array(leads[keep])],
                    names=["token", "id", "comp", "n", "rank", "leads"],
                )

    return run


def rare_pairs(texts: DataFrame, p: Params) -> DataFrame:
    """Pairs (u, v) of ``texts(id, comp, text)`` in different components that share a rare shingle early enough.

    Every pair of different components with the wanted similarity is among them. Members of a
    shingle's first component meet only those of the others, and a shingle of many members is
    dealt over tasks.
    """
    rare = cut(texts.select("id", "comp", "text").mapInArrow(_prefixer(_levels(texts, p), p), "token long, id long, comp long, n long, rank long, leads boolean"), "rare")
    met = rare.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("cnt"), F.max("leads").alias("led")).where("low < high and led")
    rare = rare.join(met.select("token", "low", "cnt"), "token").withColumn("tasks", F.ceil(F.col("cnt") / p.deal))
    other = F.col("comp") != F.col("low")
    lead = rare.where("leads").withColumn("other", F.explode(F.when(other, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    lead = lead.select("token", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("part"), F.col("id").alias("u"), F.col("comp").alias("cu"), F.col("n").alias("nu"), F.col("rank").alias("ru"))
    rest = rare.select("token", other.alias("other"), F.pmod(F.xxhash64("id"), "tasks").alias("part"), F.col("id").alias("v"), F.col("comp").alias("cv"), F.col("n").alias("nv"), F.col("rank").alias("rv"))
    enough = F.least(F.col("nu") - F.col("ru"), F.col("nv") - F.col("rv")) * (100 + p.percent) >= (F.col("nu") + F.col("nv")) * p.percent
    pairs = lead.join(rest, ["token", "other", "part"]).where((F.col("cu") != F.col("cv")) & (F.col("nu") <= F.col("nv")) & enough)
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _rest(large: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """Pairs still to confirm among the members of large buckets that hold several components."""
    at = large.join(comps.withColumnRenamed("component_id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    spread = at.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    open_ = cut(at.join(spread, "key").select("id", "comp").distinct(), "open")
    if open_.isEmpty():
        return open_.select(F.col("id").alias("u"), F.col("id").alias("v"))
    texts = cut(class_texts(open_, classes, docs, p), "open_texts")
    pairs, asked = _dealt(cut(rare_pairs(texts, p), "rare_pairs"), p)
    ends = asked.select("id").distinct()
    sketches = cut(texts.join(ends, "id").select("id", "text").mapInArrow(_fine(p), "id long, sketch binary"), "sketches")
    return _met(pairs, asked.join(sketches, "id"), "sketch").mapInArrow(_looker(p), "u long, v long")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs(doc_id, text)``."""
    signed = cut(_keyed(docs).select("doc_id", "text", "text_a", "text_b").mapInArrow(_signer(p), _SIGNED), "signed")
    speaks = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_a", "text_b"))
    classes = signed.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(speaks.alias("speaks"), F.first("bands").alias("bands"))
    classes = cut(classes.select("set_a", "set_b", "n_shingles", F.col("speaks").dropFields("unnamed").alias("speaks"), "bands", F.monotonically_increasing_id().alias("id")), "classes")
    banded = classes.select(F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    held = cut(banded.join(shared, "key"), "held")
    central = held.groupBy("id").agg(F.sum("cnt").alias("score"))
    held = cut(held.join(central, "id"), "scored")

    small, large = held.where(F.col("cnt") <= p.small_bucket), held.where(F.col("cnt") > p.small_bucket)
    a = small.select("key", F.col("id").alias("u"), F.col("n").alias("nu"))
    b = small.select("key", F.col("id").alias("v"), F.col("n").alias("nv"))
    close = a.join(b, "key").where((F.col("u") < F.col("v")) & _alike(F.col("nu"), F.col("nv"), p)).select("u", "v")
    pivot = large.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(p.pivots)).alias("part")).agg(F.max(F.struct("score", (-F.col("id")).alias("id"), "n")).alias("top"))
    pivot = pivot.select("key", (-F.col("top.id")).alias("v"), F.col("top.n").alias("nv"))
    star = large.select("key", F.col("id").alias("u"), F.col("n").alias("nu")).join(pivot, "key").where((F.col("u") != F.col("v")) & _alike(F.col("nu"), F.col("nv"), p))
    star = star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = cut(close.unionByName(star).distinct(), "pairs")

    links = cut(confirm(pairs, classes, docs, p), "links")
    comps = connected_components(links)
    rest = cut(_rest(large, comps, classes, docs, p), "rest")
    if not rest.isEmpty():
        comps = connected_components(cut(links.unionByName(confirm(rest, classes, docs, p)), "links"))

    placed = classes.join(comps, "id", "left").select("set_a", "set_b", F.col("n_shingles").alias("n_set"), F.coalesce("component_id", "id").alias("label"), F.col("speaks.doc_id").alias("first"))
    roots = placed.groupBy("label").agg(F.min("first").alias("root"))
    groups = placed.join(roots, "label").select("set_a", "set_b", "n_set", "root")
    same = (signed.set_a == groups.set_a) & (signed.set_b == groups.set_b) & (signed.n_shingles == groups.n_set)
    out = signed.join(groups, same, "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
