"""Session helpers shared by the operators: shared folders, rows carried whole, table reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a local one on a local master and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def written_at(df: DataFrame, name: str, by: str | None = None) -> str:
    """The folder of a new table in the shared folder that holds df, in partitions by one column if named."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: a short lineage that survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written_at(df, name))


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written_at`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def column(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(docs: DataFrame) -> DataFrame:
    """Each row whole in one column ``own``, so that none of its names can clash with what an operator adds."""
    return docs.select(F.struct(*[column(c) for c in docs.columns]).alias("own"))


def carried_schema(docs: DataFrame, added: str) -> StructType:
    """``own`` and the added columns (DDL)."""
    return StructType([StructField("own", docs.schema, False), *StructType.fromDDL(added).fields])


def released(rows: DataFrame, results: list[str], without: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns, then ``results``. A carried column that has the name of a result gives way to it."""
    taken = {x.lower() for x in (*results, *without)}
    own = [c for c in rows.schema["own"].dataType.names if c.lower() not in taken]
    return rows.select(*[F.col("own").getField(c).alias(c) for c in own], *results)
