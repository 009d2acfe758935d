"""Keyed tables in partitions: merges that rewrite only the partitions that an update changes.

A merge reads the touched partitions, decides which updates have an effect, writes the merged
partitions to a table of their own and only then swings them in, each partition at once; a merge
without effect writes nothing, so a repeated one changes no file. A key stays in one partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Written = Callable[[DataFrame, str], DataFrame]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def swing(rows: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """Replace the partitions that rows hold, and no other; a large partition is dealt over several zstd files by ``order``."""
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def effective(base: DataFrame, updates: DataFrame, keys: list[str], version: str, guard: Column | None = None) -> DataFrame:
    """The newest update of each key where it changes something: the key is new, or its version is not older and some value differs.

    ``guard`` is an expression over update (u) and base (b) columns; updates of known keys that fail it are refused.
    """
    rest = [c for c in updates.columns if c not in keys and c != version]
    newest = updates.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_u")).select(*keys, "_u.*").alias("u")
    old = base.withColumn("_known", F.lit(True)).alias("b")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"u.{k}").eqNullSafe(F.col(f"b.{k}"))
    differs = ~F.struct(*[F.col(f"u.{c}") for c in [version, *rest]]).eqNullSafe(F.struct(*[F.col(f"b.{c}").alias(c) for c in [version, *rest]]))
    later = differs & (F.col(f"u.{version}") >= F.col(f"b.{version}"))
    if guard is not None:
        later &= F.coalesce(guard, F.lit(False))
    return newest.join(old, on, "left").where(F.col("b._known").isNull() | later).select(*[F.col(f"u.{c}") for c in updates.columns])


def merge(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], version: str, by: list[str], written: Written, guard: Column | None = None) -> int:
    """Merge updates into the table at ``path``, partitioned by ``by``; the number of partitions rewritten."""
    updates = written(updates, "updates")
    base = spark.read.schema(updates.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], updates.schema)
    touched = base.join(updates.select(*by).distinct(), by, "left_semi")
    changes = written(effective(touched, updates, keys, version, guard), "changes")
    parts = changes.select(*by).distinct()
    n = parts.count()
    if n:
        kept = base.join(parts, by, "left_semi").join(changes.select(*keys), keys, "left_anti").select(*updates.columns)
        swing(written(kept.unionByName(changes), "merged"), path, by, keys)
    return n


def rewritten(base: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """new with ``outcome``: added, changed or unchanged against base by ``values``; keys that new lacks do not appear."""
    old = base.select(*keys, F.struct(*values).alias("_old"))
    outcome = F.when(F.col("_old").isNull(), "added").when(F.col("_old").eqNullSafe(F.struct(*values)), "unchanged").otherwise("changed")
    return new.join(old, keys, "left").withColumn("outcome", outcome).drop("_old")
