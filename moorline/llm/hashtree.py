"""Sharding by a hierarchical weighted hash tree.

Shards are leaves of a region / rack / shard tree. A document descends from the root:
at each level every child makes a draw -ln(u) / weight, with u from a hash of the
document id and the child's name, and the smallest draw wins, so a child is chosen in
proportion to its weight (the sum of its shards' weights). Draws of a child depend on
its own name and weight alone: when weights change inside one subtree, documents move
only into or out of that subtree, and the others' draws stay as they were.

Law ``key``: the document id and the number of shards decide. Growing by one shard adds
a region of its own (one rack, one shard), so only that region's weight changes, and it
takes rows only into itself.

A null doc_id is hashed as the empty string. Null text has size 8 and the crc of no
bytes. Repeated rows share a shard and take a slot each. Slots number a shard's rows
without gaps: rows are dealt by ranges of shard and id, numbered inside their range, and
the ranges' counts are summed, so no task holds a shard.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorline.llm.shared import cut


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Leaves have a shard number and a weight of their own."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


@dataclass(frozen=True)
class Tree:
    regions: int = 2
    racks: int = 3
    shards: int = 4
    extra: int = 0  #: shards added one by one, each in a region of its own
    weights: dict[int, float] = field(default_factory=dict)

    @property
    def count(self) -> int:
        return self.regions * self.racks * self.shards + self.extra

    def grown(self) -> Tree:
        return Tree(self.regions, self.racks, self.shards, self.extra + 1, self.weights)

    def root(self) -> Node:
        def leaf(name: str, n: int) -> Node:
            return Node(name, shard=n, own=self.weights.get(n, 1.0))

        top, n = [], 0
        for r in range(self.regions):
            racks = []
            for k in range(self.racks):
                racks.append(Node(f"r{r}k{k}", tuple(leaf(f"r{r}k{k}s{s}", n + s) for s in range(self.shards))))
                n += self.shards
            top.append(Node(f"r{r}", tuple(racks)))
        for x in range(self.extra):
            name = f"r{self.regions + x}"
            top.append(Node(name, (Node(f"{name}k0", (leaf(f"{name}k0s0", n),)),)))
            n += 1
        return Node("", tuple(top))


def draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight, u in (0, 1) from the first 48 bits of an md5 of key and name."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(node.name + ":"), key).cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 48)) / node.weight


def descend(key: Column, node: Node) -> Column:
    """The shard below ``node``: one level's draws, then only the winner's."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    best = F.array_min(F.array(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)])).getField("i")
    return F.element_at(F.transform(F.array(best), lambda at: _chosen(key, node, at)), 1)


def _chosen(key: Column, node: Node, at: Column) -> Column:
    out = F.when(at == 0, descend(key, node.children[0]))
    for i, c in enumerate(node.children[1:], start=1):
        out = out.when(at == i, descend(key, c))
    return out


def with_slots(df: DataFrame, shard: str, key: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with ``slot``: the place of each row in its shard by key, then by ``ties``, gapless from 0.

    Rows are dealt by ranges of (shard, key, ties, a written random number), so neither
    sparse nor null nor repeated keys crowd a part; each part numbers its rows, and the parts'
    counts (at most parts + shards rows) are summed. Both tables are written, so a part that
    is made again holds the same rows.
    """
    df = cut(df.withColumn("any", F.rand(7)), "rows")
    order = [shard, key, *ties, "any"]
    df = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).drop("any").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "dealt")
    counts = df.groupBy(shard, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(shard).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(shard).alias("s"), F.col("part").alias("p"), F.col("first"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = df.join(F.broadcast(counts), (F.col(shard) == F.col("s")) & (F.col("part") == F.col("p")))
    return out.withColumn("slot", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "s", "p", "first", "before")


def shard_documents(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs(doc_id, text)``."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.withColumn("shard", descend(key, tree.root())).withColumn("grown_shard", descend(key, tree.grown().root()))
    rows = with_slots(rows, "shard", "doc_id", ("size", "text_crc32"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
