"""Quality by compression: which of two zstandard dictionaries shortens a text more.

Dictionaries are trained on good and on bad labelled texts. A text's whole UTF-8 form
is compressed in chunks with each; the normalised size difference
(bad - good) / (bad + good), and the size it comes to for each byte, become a score by
a logistic calibration fitted on labelled texts that trained neither dictionary.

The fit uses a bounded sample (``per_class`` texts of each class, none longer than
``longest`` characters, ``most_chars`` of a class together). An id that has both labels
teaches neither. Empty or null text compresses to nothing: its features are
zero and it gets the calibration's value there. When one class has no labelled text
every score is that class's share. Repeated rows have no effect; extra columns may have
any name: a row is carried whole, and where a result is returned beside the row's own
columns, an own column of the result's name gives way to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.llm.labelled import balanced_ids, sample_texts
from moorline.llm.shared import carried, carried_schema, fold, released


@dataclass(frozen=True)
class Params:
    folds: int = 5
    held_out: int = 0
    per_class: int = 2000
    longest: int = 32_000
    most_chars: int = 12_000_000  #: of a class's sampled texts
    dictionary: int = 1 << 16
    chunk: int = 4096
    level: int = 3
    threshold: float = 0.3


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray, p: Params) -> None:
        self.good, self.bad, self.weights, self.p = good, bad, weights, p

    def open(self) -> Model:
        """Compressors for this worker."""
        self.compressors = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=self.p.level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self

    def features(self, raw: bytes) -> tuple[float, float, float]:
        """(normalised difference, compressed size for each byte under the better dictionary, shortness)."""
        if not raw:
            return 0.0, 0.0, 0.0
        step, sizes = self.p.chunk, []
        for c in self.compressors:
            sizes.append(sum(len(c.compress(raw[i : i + step])) for i in range(0, len(raw), step)))
        good, bad = sizes
        return (bad - good) / (bad + good), min(1.5, min(good, bad) / len(raw)), 1.0 / (1.0 + len(raw) / 256)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(features) @ self.weights, -30, 30)))


def _design(f: np.ndarray) -> np.ndarray:
    d, c, s = np.clip(f[:, 0], -0.4, 0.4) * 10, f[:, 1] * 2, f[:, 2]
    return np.stack([np.ones(len(f)), d, c, s, d * s, c * s], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps; classes weighted equally."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes], p: Params) -> bytes:
    """A trained dictionary; for samples too few to train one, their bytes themselves."""
    chunks = [t[i : i + p.chunk] for t in texts for i in range(0, len(t), p.chunk)]
    try:
        return zstandard.train_dictionary(p.dictionary, chunks, level=p.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[-p.dictionary :] or b" "


def _own_lines(texts: list[str]) -> list[str]:
    """Texts without lines that several of them share: boilerplate says nothing about the class it was sampled in."""
    counts = Counter(line for t in texts for line in set(t.split("\n")))
    return ["\n".join(x for x in t.split("\n") if counts[x] == 1) for t in texts]


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    rows = sample_texts(docs, balanced_ids(labels, "quality", p.folds, p.held_out, p.per_class), p.longest, p.most_chars)
    own = _own_lines([t for t, _ in rows])
    good, bad = ([(t.encode(), o.encode()) for (t, y), o in zip(rows, own, strict=True) if y == v] for v in (1, 0))
    if not good or not bad:
        return Model(b"", b"", np.array([30.0 if good else -30.0 if bad else 0.0, 0, 0, 0, 0, 0]), p)
    model = Model(_dictionary([o for _, o in good[::2]], p), _dictionary([o for _, o in bad[::2]], p), np.zeros(6), p).open()
    rest = [(t, 1) for t, _ in good[1::2] or good] + [(t, 0) for t, _ in bad[1::2] or bad]
    f = np.array([model.features(t) for t, _ in rest])
    model.weights = _logistic(_design(f), np.array([y for _, y in rest]))
    del model.compressors
    return model


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """``own`` (each row of ``docs``, whole) and quality_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value.good, shared.value.bad, shared.value.weights, shared.value.p)
        if model.good:
            model.open()
        for batch in batches:
            texts = pc.fill_null(pc.cast(batch.column(0).field("text"), pa.binary()), b"")
            f = np.array([model.features(texts[i].as_py()) if model.good else (0.0, 0.0, 0.0) for i in range(batch.num_rows)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(f))], names=["own", "quality_score"])

    return carried(docs).mapInArrow(run, carried_schema(docs, "quality_score double"))


def score(docs: DataFrame, model: Model, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs(doc_id, text)``; with ``carry``, docs' own columns and quality_score."""
    if carry:
        return released(rate(docs, model), ["quality_score"])
    p = model.p
    out = rate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("own.doc_id", "quality_score")
    return out.select("doc_id", F.coalesce(fold("doc_id", p.folds) == p.held_out, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= p.threshold).cast("int").alias("predicted"))
