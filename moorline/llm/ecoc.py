"""Language ID by error-correcting output codes over byte n-grams.

Every language has a codeword of +1 and -1. One binary classifier for each bit (ridge
regression on n-gram shares, hashed) predicts that bit; a text goes to the codeword
with the least loss, each bit's logistic loss weighted by how well the bit was told
apart on texts kept out of its fit. The score is the winner's share of exp(-loss), and
a text whose runner-up is close is flagged ambiguous.

The fit uses a bounded sample (``per_class`` texts a language, none longer than
``longest`` characters, the held-out fold excluded); only n-gram shares of that sample
reach the driver. Null text, or text without a letter, is ``und`` with score 0. A text of any length is
counted in pieces of a megabyte. With
one known language all lettered texts get it; with none, all are ``und``. Of more than
``most_languages`` values of lang (dirty data) those of most documents are learned. A row's text is
learned with its own lang, whatever other rows of its doc_id say, in any order of rows; repeated
rows count once; extra columns may have any name: a row is carried whole, and where
results are returned beside its own columns, an own column of a result's name gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.llm.labelled import balanced
from moorline.llm.shared import carried, carried_schema, fold, released
from moorline.llm.textarrays import slices, text_buffer


@dataclass(frozen=True)
class Params:
    folds: int = 3
    held_out: int = 1
    per_class: int = 700
    most: int = 12_000  #: sampled texts of all languages together: 8 KB of n-gram shares each reach the driver
    most_languages: int = 200
    longest: int = 32_000
    bins: int = 2048
    ridge: float = 1e-3
    ambiguous: float = 0.6  #: scores below it are flagged


#: Bytes outside letters become one space; ASCII letters are lower-cased.
_LETTER = np.full(256, 0x20, dtype=np.uint64)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def _slot(gram: np.ndarray, size: int, bins: int) -> np.ndarray:
    return (((gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)) >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)


def shares(column: pa.Array, bins: int) -> np.ndarray:
    """Rows x bins: root of the share of each hashed 1-, 2- and 3-gram, each length apart; unit rows."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    x = _LETTER[data]
    out = np.zeros(n * bins)
    gram = np.zeros(len(x), dtype=np.uint64)
    for size in (1, 2, 3):
        count = len(x) - size + 1
        if count <= 0:
            break
        gram = gram[:count] * np.uint64(257) + x[size - 1 :]
        inside = rows[:count] == rows[size - 1 :]
        if size > 1:
            inside &= (x[:count] != 0x20) | (x[size - 1 :] != 0x20)
        else:
            inside &= x != 0x20
        out += np.bincount((rows[:count] * bins + _slot(gram, size, bins))[inside], minlength=n * bins)
    return _unit(out.reshape(n, bins))


def long_shares(column: pa.Array, bins: int, piece: int = 1 << 20) -> np.ndarray:
    """``shares`` of a column of one text, counted piece by piece in constant memory: a gram counts where it begins."""
    data, _ = text_buffer(column)
    out = np.zeros(bins)
    for start in range(0, len(data), piece):
        x = _LETTER[data[start : start + piece + 2]]
        gram = np.zeros(len(x), dtype=np.uint64)
        for size in (1, 2, 3):
            count = len(x) - size + 1
            if count <= 0:
                break
            gram = gram[:count] * np.uint64(257) + x[size - 1 :]
            inside = (x[:count] != 0x20) | (x[size - 1 :] != 0x20)
            inside[piece:] = False
            out += np.bincount(_slot(gram, size, bins)[inside], minlength=bins)
    return _unit(out.reshape(1, bins))


def _unit(counts: np.ndarray) -> np.ndarray:
    out = np.sqrt(counts)
    return (out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


LONG = 1 << 20  #: bytes of a text beyond which it is counted in pieces


def codewords(n: int) -> np.ndarray:
    """n x bits of +1 and -1: every split of the languages while there are few, else seeded random splits far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1.0 if k == 0 or not (b >> (k - 1)) & 1 else -1.0 for b in range(1, 1 << (n - 1))] for k in range(n)])
    rng, best, most = np.random.default_rng(0), None, -1.0
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if apart > most and (np.abs(code.sum(axis=0)) < n).all():
            best, most = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  #: bins x bits
    bias: np.ndarray
    trust: np.ndarray  #: weight of each bit's loss
    p: Params

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each row of shares."""
        if len(self.languages) == 1:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        margin = 4 * (x @ self.weights + self.bias)
        loss = np.stack([(np.logaddexp(0, -margin * word) * self.trust).sum(axis=1) for word in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, share[np.arange(len(x)), best]


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"), "text")
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & F.col("text").isNotNull()).where(fold("doc_id", p.folds) != p.held_out)
    rows = balanced(rows, "label", F.xxhash64(F.lit("sample"), "doc_id", "text"), p.per_class, p.most, p.most_languages).where(F.length("text").between(1, p.longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = shares(part.column(2), p.bins)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], type=pa.binary())], names=["doc_id", "label", "x"])

    seen: dict[tuple[str, bytes], int] = {}
    for r in rows.mapInArrow(run, "doc_id long, label string, x binary").collect():
        seen[r.label, bytes(r.x)] = min(r.doc_id, seen.get((r.label, bytes(r.x)), r.doc_id))
    picked = sorted((doc, label, x) for (label, x), doc in seen.items())
    languages = sorted({label for _, label, _ in picked})
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((p.bins, code.shape[1] if len(code) else 1)), np.zeros(1), np.ones(1), p)
    x = np.frombuffer(b"".join(v for _, _, v in picked), dtype=np.float32).reshape(len(picked), -1)
    y = code[[languages.index(label) for _, label, _ in picked]]
    kept = np.arange(len(x)) % 5 == 0
    del seen

    def solve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ridge regression; only the bins x bins products are held in double precision."""
        mean, middle = x.mean(axis=0, dtype=np.float64), y.mean(axis=0)
        centred = x - mean.astype(np.float32)
        gram = (centred.T @ centred).astype(np.float64)
        gram.flat[:: len(gram) + 1] += p.ridge * len(x)
        w = np.linalg.solve(gram, centred.T.astype(np.float64) @ (y - middle))
        return w, middle - mean @ w

    w, b = solve(x[~kept], y[~kept])
    right = (np.sign(x[kept] @ w + b) == y[kept]).mean(axis=0)
    trust = np.clip(2 * right - 1, 0.05, 1.0)
    w, b = solve(x, y)
    return Model(languages, code, w.astype(np.float32), b.astype(np.float32), trust, p)


def tell(docs: DataFrame, model: Model) -> DataFrame:
    """``own`` (each row of ``docs``, whole), lang_pred, lang_score and ambiguous."""
    p = model.p
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = carried(docs).withColumn("lettered", F.coalesce(F.col("own.text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field("text"), batch.column(1)], names=["own", "text", "lettered"])
            for part in slices(batch, "text", 1 << 19):
                lettered = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                if model.languages:
                    long = part.num_rows == 1 and len(text_buffer(part.column(1))[0]) > LONG
                    best, score = model.decode((long_shares if long else shares)(part.column(1), p.bins))
                    names = [model.languages[i] if ok else "und" for i, ok in zip(best, lettered, strict=True)]
                    score = np.where(lettered, score, 0.0)
                else:
                    names, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, type=pa.string()), pa.array(score.astype(np.float64)), pa.array(score < p.ambiguous)], names=["own", *RESULTS])

    return rows.mapInArrow(run, carried_schema(docs, "lang_pred string, lang_score double, ambiguous boolean"))


RESULTS = ["lang_pred", "lang_score", "ambiguous"]


def predict(docs: DataFrame, model: Model, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each row of ``docs(doc_id, text)``; with ``carry``, docs' own columns, lang_pred, lang_score and ambiguous."""
    if carry:
        return released(tell(docs, model), RESULTS)
    p = model.p
    out = tell(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("own.doc_id", *RESULTS)
    return out.select("doc_id", F.coalesce(fold("doc_id", p.folds) == p.held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "ambiguous")
