"""Queries of the learned operators: op4, op5, op6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moorline.llm import compression, crf, ecoc
from moorline.llm.shared import table


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression.score(docs, compression.fit(docs, table(spark, sf_dir, "labels")))


def op5_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ecoc.predict(docs, ecoc.fit(docs))


def op6_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf.score(docs, crf.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op4_compression_quality, op5_output_codes, op6_crf)}
