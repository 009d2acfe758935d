"""Bounded, class-balanced samples of labelled texts for fitting.

The ids are chosen from the small label table by a hash, so their number is bounded
before any text is read; only then are they broadcast to pick the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.llm.shared import cut, fold


def balanced(rows: DataFrame, label: str, key: Column, per_class: int, most: int | None = None, most_classes: int = 200) -> DataFrame:
    """About ``per_class`` rows at most of each label and ``most`` of all, by a hash of ``key``, whatever the rows' order.

    Beyond ``most_classes`` distinct labels, those of most rows are kept (ties by label).
    """
    top = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label).limit(most_classes)
    counts = {r[label]: r["n"] for r in top.collect()}
    each = min(per_class, most // max(1, len(counts))) if most else per_class
    share: Column = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(int(min(1.0, each / n) * (1 << 32)))).otherwise(share)
    return rows.where(F.pmod(key, F.lit(1 << 32)) < share)


def balanced_ids(labels: DataFrame, label: str, parts: int, held_out: int, per_class: int) -> DataFrame:
    """doc_id and label of a balanced sample of ids, never of the held-out fold; an id that has two labels has none."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.where(fold("doc_id", parts) != held_out)
    agreed = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    return balanced(agreed, "label", F.xxhash64(F.lit("sample"), "doc_id"), per_class)


def sample_texts(docs: DataFrame, ids: DataFrame, longest: int, most_chars: int | None = None) -> list[tuple[str, object]]:
    """(text, label) of the chosen ids, in a fixed order; texts longer than ``longest`` are left out of the fit, and equal texts count once.

    With ``most_chars``, each class keeps the first texts by a hash of the id that hold that many characters together.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text").between(1, longest))
    picked = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
    if most_chars:
        picked = cut(picked, "sample")
        sizes = picked.select("doc_id", "label", F.length("text").alias("n"), F.xxhash64(F.lit("order"), "doc_id").alias("h")).collect()
        room, kept = {}, set()
        for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
            room[r.label] = room.get(r.label, most_chars) - r.n
            if room[r.label] >= 0:
                kept.add(r.doc_id)
        if len(kept) < len({r.doc_id for r in sizes}):
            picked = picked.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in sorted(kept)], "doc_id long")), "doc_id", "left_semi")
    seen: dict[str, object] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.doc_id, r.text)):
        seen.setdefault(r.text, r.label)
    return list(seen.items())
