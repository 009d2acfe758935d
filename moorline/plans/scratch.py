"""Intermediate tables in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; where the setting is missing, a local one on a local master and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            at = held.get()
        elif spark.sparkContext.master.startswith("local"):
            at = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(at)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table, written once and read again: several uses cost one run, and lost executors do not start it over."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """A table of few bytes whose rows are about to grow, in two partitions for each core: left to its size, it would end in one task, and so would all that grows from it.

    It is dealt by a hash of the columns: a deal by the columns themselves is taken out where a grouping by them stands before, and that one's shuffle is cut to its size.
    """
    return df.repartition(2 * max(df.sparkSession.sparkContext.defaultParallelism, 4), F.xxhash64(*by))


def files_in(spark: SparkSession, path: str) -> tuple[int, int]:
    """How many Parquet files a folder and its partitions hold, and their bytes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    n = size = 0
    while found.hasNext():
        x = found.next()
        if x.getPath().getName().endswith(".parquet"):
            n, size = n + 1, size + x.getLen()
    return n, size
