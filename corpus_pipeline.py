"""Corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

A filtering stage drops what its operator rejects and nothing else, and returns the
columns it was given, which may have any names beside doc_id and text, since rows are
carried whole; packing, the last, returns pieces of sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.llm import compression, ecoc, minhash, packing, winnow
from moorline.llm.shared import carried, cut, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at its threshold or above."""
    model = compression.fit(docs, table(spark, sf_dir, "labels"))
    return compression.rate(docs, model).where(F.col("quality_score") >= model.p.threshold).select("own.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: the operator's ``und`` (no letter, or no language known) go."""
    return ecoc.tell(docs, ecoc.fit(docs)).where(F.col("lang_pred") != "und").select("own.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one of smallest doc_id, rows without an id last.

    Groups are those of rows, not of ids: every row gets a key of its own, written before it is used. A text
    without words is near no other, so each of its rows stays.
    """
    keyed = cut(carried(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = minhash.near_duplicates(keyed.select(F.col("row").alias("doc_id"), F.col("own.text").alias("text"))).select(F.col("doc_id").alias("row"), "component_id")
    ids = keyed.select("row", F.col("own.doc_id").alias("doc_id"))
    first = groups.join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    return keyed.join(first.select("first.row"), "row", "left_semi").select("own.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return winnow.judge(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select("own.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of cost-balanced token sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("packing", pack)]

#: Models and tokenizers have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
