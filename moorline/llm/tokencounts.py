"""Exact token-length histogram, with suffix sums for every context limit.

Each text is encoded once; documents are aggregated by encoded length (a partial
aggregate, so a task sends one row for each length it met). Suffix sums over lengths
then answer, for a limit L at or between histogram rows: how many documents fit, how
many tokens lie in longer documents, and how many remain when every document is
truncated to L. The sums run inside blocks of lengths, and over the few block totals,
so no task holds the whole histogram.

Null text has no tokens (length 0); texts may be of any length, long runs of white space
included; repeated rows count each; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moorline.llm.packing import encode_text, encoder
from moorline.llm.shared import cut

BLOCK = 1024  #: lengths in a block of the suffix sums


def token_lengths(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """n_tokens of each row of ``docs(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(0)
            n = np.fromiter((len(encode_text(encode, texts[i].as_py() or "")) for i in range(len(texts))), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(n)], names=["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length: its documents, and sums over longer and over shorter documents."""
    counts = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK).cast("long"))
    counts = cut(counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "lengths")  # read twice below: the texts are encoded once
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("block").alias("b"),
        F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("block_docs").over(whole).alias("all_docs"),
        F.sum("block_tokens").over(whole).alias("all_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(blocks, F.col("block") == F.col("b"))
    out = out.withColumn("docs_longer", F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("docs_after"))
    out = out.withColumn("tokens_longer", F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("tokens_after"))
    fit = F.col("all_docs") - F.col("docs_longer")
    return out.select(
        "n_tokens",
        "n_docs",
        fit.alias("docs_at_most"),
        (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_at_most"),
        "docs_longer",
        "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("tokens_truncated"),
        (fit / F.col("all_docs")).alias("quantile"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_at_most, tokens_truncated for any limits, from the longest histogram row not above each."""
    asked = hist.sparkSession.createDataFrame([(x,) for x in limits], "limit long")
    below = asked.join(F.broadcast(hist.agg(F.sum("n_docs").alias("all_docs"))))
    base = asked.join(hist, F.col("n_tokens") <= F.col("limit"), "left").groupBy("limit").agg(F.max_by(F.struct("docs_at_most", "tokens_at_most"), "n_tokens").alias("row"))
    fit = F.coalesce(F.col("row.docs_at_most"), F.lit(0))
    return base.join(below, "limit").select("limit", fit.alias("docs_at_most"), (F.coalesce(F.col("row.tokens_at_most"), F.lit(0)) + F.col("limit") * (F.col("all_docs") - fit)).alias("tokens_truncated"))


def quantile(hist: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return hist.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
