"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions alone.

1. **Targets.** Sources, in code-point order (null last), weigh ``weights`` in turn and share
   the corpus's words. A target stops at ``most`` times its source's size and the excess is
   shared again by weight until none is above: one aggregate a round, and rounds only while
   another source stops.
2. **Line and blocks.** A source's documents stand in the order of a seeded md5 of id and text
   (a permutation), one after the other on a line of words, and the line repeats once for each
   epoch. Its blocks are ``block`` consecutive words. A source's quota is the blocks of its
   target; the last one is cut so that its words come to the target rounded.
3. **Splitting tree.** All quotas together are dealt among the output shards: a node's blocks
   go to its two halves by a multivariate hypergeometric draw (each source in turn a
   hypergeometric draw on what the sources before it left), so every shard holds its exact
   number of blocks and every source gives its exact quota. Draws come from hashes of the
   seed, node and source.
4. **Draws.** A shard takes the next so many blocks of each source's line: disjoint, permuted
   blocks, of which no document is taken more than ``most`` times.
5. **Local shuffle.** Inside a shard pieces are ordered by a hash (``shards``, ``texts``).

Offsets on a line are sums inside buckets of the permutation plus sums of the buckets before,
so a source that holds most rows is dealt over as many tasks as it has buckets. One row of
the tree holds the quotas of all sources: 8 bytes for each source, and time by the square
of their number in copies, so a mix is meant for thousands of sources, not one for each document.

Null text has no words. Documents without words are in the result and take nothing. Rows
of equal id and text may change places with each other and nothing else; any rerun, whatever
the partitions, gives the same rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorline.llm.hashtree import with_slots
from moorline.llm.shared import cut


@dataclass(frozen=True)
class Params:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most: int = 3  #: times a document may be taken
    block: int = 1024  #: words
    shard_blocks: int = 8192  #: blocks of an output shard, about
    bucket: int = 1024  #: rows that share a running sum, about
    most_broadcast: int = 200_000  #: rows of a table sent to every task; larger ones are joined by a shuffle
    seed: str = "mix"


SPACE = " \t\n\x0b\x0c\r"


def named(text: Column, doc_id: Column, p: Params) -> Column:
    """The name of a row in the permutation."""
    return F.md5(F.concat(F.lit(p.seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def measured(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """row, doc_id, source, size (words) and name of each document, written: texts are read once."""
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.length(F.translate(words, SPACE, "")).cast("long").alias("size"),
        named(F.col("text"), F.col("doc_id"), p).alias("name"),
    )
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "origin": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull()})
    return cut(rows, "sizes")


def targets(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """origin, unnamed, rank, weight, source_size, target, words (taken) and quota (blocks) of each source."""
    sources = rows.groupBy("origin", "unnamed").agg(F.sum("size").alias("source_size")).withColumn("all", F.lit(0))
    sources = with_slots(sources, "all", "unnamed", ("origin",)).withColumnRenamed("slot", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), (F.col("rank") % len(p.weights) + 1).cast("int"))
    sources = cut(sources.select("origin", "unnamed", "rank", weight.alias("weight"), "source_size", (F.col("source_size") * p.most).alias("limit")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    unit, stopped = 0.0, -1
    while True:
        over = F.col("limit") < unit * F.col("weight")
        r = sources.agg(F.sum(F.when(over, F.col("limit")).otherwise(0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(over.cast("int")).alias("n")).first()
        if r.n == stopped or not r.open:
            break
        unit, stopped = (total - r.full) / r.open, r.n
    target = F.least(F.col("limit").cast("double"), unit * F.col("weight"))
    out = sources.withColumn("target", target).withColumn("words", F.least(F.floor(F.col("target") + 0.5), F.col("limit")))
    return cut(out.withColumn("quota", F.ceil(F.col("words") / p.block)), "targets")


def log_factorial(n: Column) -> Column:
    """ln n!, by a table below 16 and Stirling's series from there (error below 1e-12)."""
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.log(x) - x + 0.5 * F.log(x * 6.283185307179586) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 16, F.log(F.factorial(F.greatest(F.least(n, F.lit(16)), F.lit(0)).cast("int")).cast("double"))).otherwise(series)


def hypergeometric(all_: Column, good: Column, drawn: Column, u: Column, v: Column, widest: float = 100.0) -> Column:
    """Successes among ``drawn`` of ``all_`` of which ``good`` are successes, from u and v uniform in (0, 1).

    By inversion of u over the counts within ten standard deviations and two of the mean (odds of others below
    1e-20); with a standard deviation above ``widest``, by the rounded normal draw of u and v.
    """

    def let(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), then), 1)

    size = F.greatest(all_, F.lit(1)).cast("double")
    mean = drawn.cast("double") * good / size
    spread = F.sqrt(F.greatest(mean * (1 - good / size) * (all_ - drawn) / F.greatest(all_ - 1, F.lit(1)), F.lit(0.0)))
    least, most = F.greatest(F.lit(0).cast("long"), drawn - (all_ - good)), F.least(drawn, good)
    known = F.struct(mean.alias("mean"), spread.alias("spread"), least.cast("long").alias("least"), most.cast("long").alias("most"))

    def odds(x: Column) -> Column:
        return -(log_factorial(x) + log_factorial(good - x) + log_factorial(drawn - x) + log_factorial(all_ - good - drawn + x))

    def narrow(x: Column) -> Column:
        low = F.greatest(x["least"], F.floor(x["mean"] - 10 * x["spread"] - 2))
        high = F.greatest(low, F.least(x["most"], F.ceil(x["mean"] + 10 * x["spread"] + 2)))
        top = F.least(F.greatest(F.floor(x["mean"]).cast("long"), low), high)
        return let(odds(top), lambda best: let(F.transform(F.sequence(low, high), lambda k: F.exp(odds(k) - best)), lambda w: low + _below(w, u)))

    def wide(x: Column) -> Column:
        at = F.round(x["mean"] + x["spread"] * F.sqrt(-2 * F.log(u)) * F.cos(6.283185307179586 * v)).cast("long")
        return F.least(F.greatest(at, x["least"]), x["most"])

    return let(known, lambda x: F.when(x["spread"] > widest, wide(x)).when(x["least"] >= x["most"], x["least"]).otherwise(narrow(x)))


def _below(weights: Column, u: Column) -> Column:
    """How many of the weights' running sums stay at or below u times their total."""
    bar = u * F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))
    run = F.aggregate(weights, start, lambda a, w: F.struct((a["sum"] + w).alias("sum"), (a["n"] + F.when(a["sum"] + w <= bar, 1).otherwise(0)).cast("long").alias("n")))
    return F.least(run["n"], (F.size(weights) - 1).cast("long"))


def split(quotas: Column, draws: Column, key: list[Column]) -> Column:
    """The left half's blocks of each source: a multivariate hypergeometric draw of ``draws`` out of ``quotas``."""
    none = F.lit(None).cast("array<long>")
    start = F.struct(F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q).alias("all"), draws.cast("long").alias("draws"), F.coalesce(none, F.array().cast("array<long>")).alias("out"))

    def step(a: Column, q: Column) -> Column:
        u, v = ((F.shiftrightunsigned(F.xxhash64(*key, F.size(a["out"]), F.lit(i)), 11) + 0.5) / float(1 << 53) for i in (0, 1))
        return F.element_at(F.transform(F.array(hypergeometric(a["all"], q, a["draws"], u, v)), lambda v: F.struct((a["all"] - q).alias("all"), (a["draws"] - v).alias("draws"), F.concat(a["out"], F.array(v)).alias("out"))), 1)

    return F.aggregate(quotas, start, step)["out"]


def deal(sources: DataFrame, p: Params = Params()) -> DataFrame:
    """rank, shard, first, last (excluded): the blocks of each source's line that each shard takes."""
    total = sources.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-total // p.shard_blocks))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "quota")))
    nodes = sources.agg(F.transform(ordered, lambda x: x["quota"]).alias("quotas")).select(F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("leaves"), "quotas")
    to = lambda leaf: F.call_function("div", leaf * F.lit(total).cast("long"), F.lit(shards).cast("long"))  # noqa: E731  blocks of the shards before one
    for level in range((shards - 1).bit_length()):
        half = F.floor((F.col("leaves") + 1) / 2)
        left = split(F.col("quotas"), to(F.col("shard") + half) - to(F.col("shard")), [F.lit(p.seed), F.col("shard"), F.col("leaves")])
        nodes = nodes.withColumns({"half": half, "left": F.when(F.col("leaves") > 1, left).otherwise(F.col("quotas"))})
        right = F.struct((F.col("shard") + F.col("half")).alias("shard"), (F.col("leaves") - F.col("half")).alias("leaves"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas"))
        both = F.array(F.struct("shard", F.col("half").alias("leaves"), F.col("left").alias("quotas")), right)
        nodes = nodes.select(F.explode(both).alias("x")).select("x.*").where("leaves > 0")
        if level % 4 == 3:
            nodes = cut(nodes.repartition(F.col("shard")), "nodes")
    counts = nodes.select("shard", F.posexplode("quotas").alias("rank", "blocks"))
    until = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("last", F.sum("blocks").over(until)).where("blocks > 0")
    return cut(counts.select(F.col("rank").cast("long").alias("rank"), "shard", (F.col("last") - F.col("blocks")).alias("first"), "last").withColumn("shards", F.lit(shards)), "dealt")


def _sized(side: DataFrame, p: Params) -> DataFrame:
    """A written table, sent to every task if its rows are few."""
    return F.broadcast(side) if side.count() <= p.most_broadcast else side


def lines(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """rows with ``begin``, the words before each on its source's line."""
    buckets = max(1, -(-rows.count() // p.bucket))
    digits = F.conv(F.substring("name", 1, 12), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(digits / ((1 << 48) / buckets)))
    key = ["origin", "unnamed", "bucket"]
    before = Window.partitionBy("origin", "unnamed").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key).agg(F.sum("size").alias("words")).select(*key, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*key).orderBy("name", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, key)
    return placed.withColumn("begin", F.col("before") + F.col("inside")).drop("bucket", "before", "inside")


def draw(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The mix in pieces: every document, with epoch, start (its words before), length, block, shard and place of each piece taken of it.

    A document that nothing is taken of has one row with these null. ``place`` orders the pieces of a shard.
    """
    rows = measured(docs, p)
    sources = targets(rows, p)
    dealt = deal(sources, p)
    rows = lines(rows, p).join(_sized(sources.drop("weight", "limit"), p), ["origin", "unnamed"])
    # A document's words on each repeat of the line, as far as the source's words are taken.
    begin = lambda e: e * F.col("source_size") + F.col("begin")
    epochs = F.transform(F.sequence(F.lit(0), F.lit(p.most - 1)), lambda e: F.struct(e.alias("epoch"), begin(e).alias("from"), F.least(begin(e) + F.col("size"), F.col("words")).alias("to")))
    rows = rows.withColumn("e", F.explode_outer(F.filter(epochs, lambda x: x["from"] < x["to"])))
    runs = F.transform(F.sequence(F.floor(F.col("e.from") / p.block), F.floor((F.col("e.to") - 1) / p.block)), lambda b: F.struct(b.alias("block"), F.greatest(F.col("e.from"), b * p.block).alias("from"), F.least(F.col("e.to"), (b + 1) * p.block).alias("to")))
    rows = rows.withColumn("b", F.explode_outer(runs)).select("row", "doc_id", "source", "size", "name", "source_size", "target", "rank", "quota", F.col("e.epoch").alias("epoch"), F.col("b.block").alias("block"), (F.col("b.from") - F.col("e.from")).alias("start"), (F.col("b.to") - F.col("b.from")).alias("length"))
    # The shard that takes a block: an equi-join on steps of a line about as long as a shard's share of it.
    share = sources.select("rank", "quota").join(dealt, "rank").withColumn("step", F.greatest(F.lit(1), F.floor(F.col("quota") / F.col("shards"))))
    spans = share.select("rank", "shard", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / F.col("step")), F.floor((F.col("last") - 1) / F.col("step")))).alias("at"))
    spans = cut(spans, "spans")
    shards = dealt.select("shards").first()
    rows = rows.withColumn("at", F.floor(F.col("block") / F.greatest(F.lit(1), F.floor(F.col("quota") / (shards[0] if shards else 1)))))
    spans = _sized(spans.withColumnsRenamed({"rank": "r", "at": "a"}), p)
    taken = rows.join(spans, (F.col("rank") == F.col("r")) & (F.col("at") == F.col("a")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("last")), "left")
    place = F.when(F.col("shard").isNotNull(), F.xxhash64(F.lit(p.seed), "shard", "name", "epoch", "block"))
    return taken.select("row", "doc_id", "source", "size", "name", "source_size", "target", "epoch", "start", "length", "block", "shard", place.alias("place"))


def shards(pieces: DataFrame) -> DataFrame:
    """The pieces of each shard together and in its shuffled order, ready to be written by shard."""
    return pieces.where(F.col("shard").isNotNull()).repartition("shard").sortWithinPartitions("shard", "place", "name", "start")


def texts(docs: DataFrame, pieces: DataFrame, p: Params = Params()) -> DataFrame:
    """shard, place, doc_id, epoch and the words of each piece, in shuffled order; texts are joined to pieces by name."""
    whole = docs.select(named(F.col("text"), F.col("doc_id"), p).alias("name"), "text").dropDuplicates(["name"])
    got = pieces.where(F.col("shard").isNotNull()).join(whole, "name")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = got.withColumn("text", F.array_join(F.slice(words, (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " "))
    return shards(out).select("shard", "place", "doc_id", "epoch", "start", "length", "text")


def taken(pieces: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), pieces and first shard of each document."""
    out = pieces.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("taken"), F.count("shard").alias("n_pieces"), F.min("shard").alias("first_shard"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "first_shard")
