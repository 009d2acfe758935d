"""Connected components of an edge table, distributed: min-label steps with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.llm.shared import cut


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find inside a batch: its edges become one edge from each node to the smallest id of its local group."""
    for batch in batches:
        u, v = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(u):
            continue
        nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
        parent = list(range(len(nodes)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(flat[: len(u)].tolist(), flat[len(u) :].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        root = np.fromiter((find(i) for i in range(len(nodes))), dtype=np.int64, count=len(nodes))
        keep = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], names=["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node of ``edges(u, v)``; component_id is the smallest id reachable.

    Each round sends every node the smallest label of its neighbours by a partial
    aggregate and then replaces labels by their labels' labels, so that a chain of n
    nodes needs about log n rounds. No group is ever held by one task.
    """
    forest = cut(edges.select("u", "v").mapInArrow(_local_forest, "u long, v long"), "forest")
    both = forest.unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    labels = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label"))
    labels = cut(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("far"))
        step = cut(step.join(jump, "next").select("id", "label", F.least("next", "far").alias("next")), "labels")
        labels = step.select("id", F.col("next").alias("label"))
        if step.where("label <> next").isEmpty():
            return labels.withColumnRenamed("label", "component_id")
