"""Toxic spans by a linear-chain conditional random field over words.

Training tokens come from labelled texts: a unit (a whole word, or its first 4 to 6
characters) found in toxic texts and practically never in clean ones marks the words
that carry it inside toxic texts; all other words are clean tokens. Sentences (cut at
. ! ? or a line end) with these tags train a two-state CRF whose word scores are sums of hashed features (word, first 3 to 6 characters, last 3),
by stochastic gradients; the word feature is dropped at random so that unseen endings
of known stems still count.

Scoring runs forward-backward over every sentence of every whole text, however long: a
sentence beyond ``PIECE`` words is read in pieces between which the scores are carried,
which is exact, and a text beyond ``LONG`` bytes some whole sentences at a time. In the fit alone longer sentences count as several of ``chain`` words.
Words whose marginal passes ``span`` are offending spans (byte offsets); the text's score is its
greatest marginal. Null, empty and wordless texts have score 0 and no spans. The fit
uses a bounded sample (``per_class`` texts and ``most_chars`` characters of each class,
none longer than ``longest`` characters, the held-out fold excluded); without toxic
units every score is 0. An id that has both labels teaches neither. Repeated rows and extra columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.llm.labelled import balanced_ids, sample_texts
from moorline.llm.shared import fold
from moorline.llm.textarrays import ALNUM, as_column, mix, sentence_pieces, slices, text_buffer, word_bounds, word_hashes


@dataclass(frozen=True)
class Params:
    folds: int = 3
    held_out: int = 1
    per_class: int = 3000
    longest: int = 32_000
    most_chars: int = 8_000_000
    support: int = 3  #: toxic texts a unit must be in, and one more for every ``support_each`` toxic texts; of a few toxic texts fewer,
    support_each: int = 500
    support_few: int = 150  #: namely one and one more for every ``support_few`` of them
    purity: float = 0.98  #: share of toxic texts among a unit's texts, classes weighted equally
    slots: int = 1 << 18  #: hashed feature weights
    others: int = 40_000  #: clean sentences in the fit
    chain: int = 64  #: longest sentence of the fit in words
    epochs: int = 3  #: over the sentences of a round, and more when they are few
    updates: int = 250  #: gradient steps a round at least
    batch: int = 1024
    rounds: int = 3  #: after each, clean sentences that the model finds suspicious join the fit
    rate: float = 0.5
    l2: float = 1e-6
    span: float = 0.5
    threshold: float = 0.7


PREFIXES, SUFFIX = (3, 4, 5, 6), 3
BLOCK = 8192  #: sentences (or pieces of long ones) that forward-backward pads together
MARKS = b".!?\n"  #: bytes after a word that end its sentence
LONG = 1 << 20  #: bytes of a text beyond which it is scored some sentences at a time
PIECE = 64  #: words of a piece of a long sentence


def _cut_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chars: int) -> np.ndarray:
    """End offset of each word's first ``chars`` characters (UTF-8 aware), at most its end."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    goal = lead[starts] + chars
    stop = np.searchsorted(lead[1:], goal, side="right")  # first byte of the next character
    return np.minimum(stop, ends)


class Tokens:
    """Words of a slice of texts: bounds, rows, unit hashes and sentence numbers."""

    def __init__(self, column: pa.Array, chain: int | None = None) -> None:
        self.data, self.offsets = text_buffer(column)
        self.n_rows = len(self.offsets) - 1
        self.starts, self.ends, self.rows = word_bounds(self.data, self.offsets, ALNUM)
        n = len(self.starts)
        self.word = word_hashes(self.data, self.starts, self.ends)
        self.prefix = [mix(word_hashes(self.data, self.starts, _cut_at(self.data, self.starts, self.ends, k)) + np.uint64(k)) for k in PREFIXES]
        size = self.ends - self.starts
        self.suffix = mix(word_hashes(self.data, self.ends - np.minimum(size, SUFFIX), self.ends) + np.uint64(99))
        after = np.zeros(n, dtype=np.uint8)
        inside = self.ends < len(self.data)
        after[inside] = self.data[self.ends[inside]]
        first = np.zeros(n, dtype=bool)
        if n:
            first[0] = True
            first[1:] = (self.rows[1:] != self.rows[:-1]) | np.isin(after[:-1], np.frombuffer(MARKS, dtype=np.uint8))
        if chain:
            begin = np.flatnonzero(first)
            place = np.arange(n) - np.repeat(begin, np.diff(np.concatenate([begin, [n]])))
            first |= (place % chain == 0) & (place > 0)
        self.begin = np.flatnonzero(first)
        self.length = np.diff(np.concatenate([self.begin, [n]]))

    def features(self, slots: int) -> np.ndarray:
        return np.stack([(h % np.uint64(slots)).astype(np.int32) for h in (self.word, *self.prefix, self.suffix)], axis=1)

    def units(self) -> list[np.ndarray]:
        return [self.word, *self.prefix[1:]]


@dataclass
class Crf:
    weights: np.ndarray  #: feature scores of the toxic state
    bias: float
    start: np.ndarray  #: 2
    move: np.ndarray  #: 2 x 2

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1) + self.bias


def _pad(values: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    at = begin[:, None] + np.arange(width)
    mask = np.arange(width) < length[:, None]
    return np.where(mask, values[np.minimum(at, len(values) - 1)], 0.0), mask


def forward_backward(e: np.ndarray, mask: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward scores (sentences x words x 2) and log partition; state 0 scores 0 at each word, state 1 scores e."""
    n, width = e.shape
    alpha, beta = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    alpha[:, 0, 0], alpha[:, 0, 1] = start[0], start[1] + e[:, 0]
    for t in range(1, width):
        prev = alpha[:, t - 1]
        a0 = np.logaddexp(prev[:, 0] + move[0, 0], prev[:, 1] + move[1, 0])
        a1 = np.logaddexp(prev[:, 0] + move[0, 1], prev[:, 1] + move[1, 1]) + e[:, t]
        on = mask[:, t]
        alpha[:, t, 0], alpha[:, t, 1] = np.where(on, a0, prev[:, 0]), np.where(on, a1, prev[:, 1])
    for t in range(width - 2, -1, -1):
        n0, n1 = beta[:, t + 1, 0], beta[:, t + 1, 1] + e[:, t + 1]
        on = mask[:, t + 1]
        beta[:, t, 0] = np.where(on, np.logaddexp(move[0, 0] + n0, move[0, 1] + n1), 0.0)
        beta[:, t, 1] = np.where(on, np.logaddexp(move[1, 0] + n0, move[1, 1] + n1), 0.0)
    return alpha, beta, np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])


def _transfer(e: np.ndarray, mask: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Log scores (pieces x state before x last state) of passing through each padded piece."""
    out = np.stack([np.stack([np.full(len(e), move[a, 0]), move[a, 1] + e[:, 0]], axis=1) for a in (0, 1)], axis=1)
    for t in range(1, e.shape[1]):
        n0 = np.logaddexp(out[:, :, 0] + move[0, 0], out[:, :, 1] + move[1, 0])
        n1 = np.logaddexp(out[:, :, 0] + move[0, 1], out[:, :, 1] + move[1, 1]) + e[:, t, None]
        on = mask[:, t, None]
        out = np.stack([np.where(on, n0, out[:, :, 0]), np.where(on, n1, out[:, :, 1])], axis=2)
    return out


def long_marginals(crf: Crf, e: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, probability of the toxic state) of each word of sentences of any length.

    Pieces of PIECE words of all sentences are passed through together, once to learn how
    each carries scores over itself and once with the scores that reach it from both sides;
    between these, scores are handed from piece to piece, all sentences at a time.
    """
    counts = -(-length // PIECE)
    first = np.cumsum(counts) - counts
    number = np.arange(counts.sum()) - np.repeat(first, counts)
    starts = np.repeat(begin, counts) + number * PIECE
    padded, mask = _pad(e, starts, np.minimum(np.repeat(length, counts) - number * PIECE, PIECE), PIECE)
    over = _transfer(padded, mask, crf.move)
    left, right = np.zeros((len(starts), 2)), np.zeros((len(starts), 2))  # scores at the word before each piece, and after it
    left[first + 1] = forward_backward(padded[first], mask[first], crf.start, crf.move)[0][:, -1]
    for i in range(2, int(counts.max())):
        at = first[counts > i] + i
        left[at] = np.logaddexp(left[at - 1, :1] + over[at - 1, 0], left[at - 1, 1:] + over[at - 1, 1])
    for i in range(int(counts.max()) - 2, -1, -1):
        at = first[counts > i + 1] + i
        right[at] = np.logaddexp(over[at + 1, :, 0] + right[at + 1, :1], over[at + 1, :, 1] + right[at + 1, 1:])
    enter = np.logaddexp(left[:, :1] + crf.move[0], left[:, 1:] + crf.move[1])
    enter[first] = crf.start
    alpha = np.zeros((*mask.shape, 2))
    alpha[:, 0, 0], alpha[:, 0, 1] = enter[:, 0], enter[:, 1] + padded[:, 0]
    for t in range(1, PIECE):
        prev = alpha[:, t - 1]
        alpha[:, t, 0] = np.logaddexp(prev[:, 0] + crf.move[0, 0], prev[:, 1] + crf.move[1, 0])
        alpha[:, t, 1] = np.logaddexp(prev[:, 0] + crf.move[0, 1], prev[:, 1] + crf.move[1, 1]) + padded[:, t]
    beta = np.zeros((*mask.shape, 2))
    last = mask.sum(axis=1) - 1
    beta[np.arange(len(starts)), last] = right
    for t in range(PIECE - 2, -1, -1):
        own = t < last
        n0, n1 = beta[own, t + 1, 0], beta[own, t + 1, 1] + padded[own, t + 1]
        beta[own, t, 0] = np.logaddexp(crf.move[0, 0] + n0, crf.move[0, 1] + n1)
        beta[own, t, 1] = np.logaddexp(crf.move[1, 0] + n0, crf.move[1, 1] + n1)
    both = (alpha + beta)[mask]
    return (starts[:, None] + np.arange(PIECE))[mask], 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))


def marginals(crf: Crf, tokens: Tokens, features: np.ndarray) -> np.ndarray:
    """Probability of the toxic state for each word, sentence by sentence."""
    out = np.zeros(len(tokens.starts))
    if not len(out):
        return out
    e = crf.emissions(features)
    low = 0
    for width in (4, 8, 16, 32, PIECE):
        alike = np.flatnonzero((tokens.length > low) & (tokens.length <= width))
        low = width
        for at in range(0, len(alike), BLOCK):
            pick = alike[at : at + BLOCK]
            begin, length = tokens.begin[pick], tokens.length[pick]
            padded, mask = _pad(e, begin, length, int(length.max()))
            alpha, beta, z = forward_backward(padded, mask, crf.start, crf.move)
            p = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], 0.0))
            out[(begin[:, None] + np.arange(mask.shape[1]))[mask]] = p[mask]
    long = np.flatnonzero(tokens.length > PIECE)
    for at in range(0, len(long), BLOCK // 4):
        pick = long[at : at + BLOCK // 4]
        places, p = long_marginals(crf, e, tokens.begin[pick], tokens.length[pick])
        out[places] = p
    return out


def tag(rows: list[tuple[str, int]], p: Params) -> tuple[Tokens, np.ndarray]:
    """Token labels of labelled texts: 1 on words of toxic texts that carry a toxic unit."""
    tokens = Tokens(pa.array([t for t, _ in rows]), p.chain)
    label = np.array([y for _, y in rows])
    toxic = label[tokens.rows] == 1
    y = np.zeros(len(tokens.starts), dtype=bool)
    n_toxic = int((label == 1).sum())
    share = max(1, n_toxic) / max(1, (label == 0).sum())
    least = min(1 + n_toxic // p.support_few, p.support + n_toxic // p.support_each)
    for h in tokens.units():
        values, unit = np.unique(h, return_inverse=True)
        pairs = np.unique(unit.astype(np.int64) * len(label) + tokens.rows)  # each unit once for each text
        bad = label[pairs % len(label)] == 1
        hit = np.bincount(pairs[bad] // len(label), minlength=len(values))
        miss = np.bincount(pairs[~bad] // len(label), minlength=len(values)) * share
        good = (hit >= least) & (hit / np.maximum(hit + miss, 1e-9) >= p.purity)
        y |= good[unit] & toxic
    return tokens, y


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Crf:
    rows = sample_texts(docs, balanced_ids(labels, "toxic", p.folds, p.held_out, p.per_class), p.longest, p.most_chars)
    crf = Crf(np.zeros(p.slots), -4.0, np.zeros(2), np.array([[0.5, -0.5], [0.0, 0.0]]))
    if not rows:
        return Crf(crf.weights, -60.0, crf.start, crf.move)
    tokens, y = tag(rows, p)
    if not y.any():
        return Crf(crf.weights, -60.0, crf.start, crf.move)
    features = tokens.features(p.slots)
    tokens.word = tokens.suffix = None
    tokens.prefix = []
    sentence = np.repeat(np.arange(len(tokens.begin)), tokens.length)
    with_toxic = np.unique(sentence[y])
    rng = np.random.default_rng(0)
    others = np.setdiff1d(np.arange(len(tokens.begin)), with_toxic)
    others = rng.permutation(others)[: max(p.others, 4 * len(with_toxic))]
    train = np.concatenate([with_toxic, others])
    square, sq = np.full(p.slots, 1e-2), np.full(7, 1e-2)
    clean = np.ones(len(tokens.begin), dtype=bool)
    clean[with_toxic] = False
    epochs = max(p.epochs, -(-p.updates // -(-len(train) // p.batch)))
    for epoch in range(epochs * p.rounds):
        if epoch and epoch % epochs == 0:
            worst = np.zeros(len(tokens.begin))
            np.maximum.at(worst, sentence, marginals(crf, tokens, features))
            hard = np.flatnonzero(clean & (worst > 0.02))
            train = np.union1d(train, hard[np.argsort(-worst[hard], kind="stable")][: p.others])
        rng.shuffle(train)
        for at in range(0, len(train), p.batch):
            pick = train[at : at + p.batch]
            begin, length = tokens.begin[pick], tokens.length[pick]
            width = int(length.max())
            places = begin[:, None] + np.arange(width)
            mask = np.arange(width) < length[:, None]
            own = places[mask]
            f = features[own]
            keep = np.ones(f.shape)
            keep[:, 0] = rng.random(len(f)) < 0.5
            scores = (crf.weights[f] * keep).sum(axis=1) + crf.bias
            e = np.zeros(mask.shape)
            e[mask] = scores
            alpha, beta, z = forward_backward(e, mask, crf.start, crf.move)
            p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
            gold = np.zeros(mask.shape)
            gold[mask] = y[own]
            gap = (gold - p1)[mask]
            g = np.zeros(p.slots)
            np.add.at(g, f.ravel(), (gap[:, None] * keep).ravel())
            g = g / len(pick) - p.l2 * crf.weights
            square += g * g
            crf.weights += p.rate * g / np.sqrt(square)
            both = mask[:, 1:]
            small = np.zeros(7)
            small[0] = gap.sum()
            small[1], small[2] = ((1 - gold[:, 0]) - (1 - p1[:, 0])).sum(), (gold[:, 0] - p1[:, 0]).sum()
            for a in (0, 1):
                for b in (0, 1):
                    seen = ((gold[:, :-1] == a) & (gold[:, 1:] == b))[both].sum()
                    edge = alpha[:, :-1, a] + crf.move[a, b] + (e[:, 1:] if b else 0.0) + beta[:, 1:, b] - z[:, None]
                    small[3 + 2 * a + b] = seen - np.exp(np.minimum(edge, 0.0))[both].sum()
            small /= len(pick)
            sq += small * small
            step = 0.1 * small / np.sqrt(sq)
            crf.bias += step[0]
            crf.start = crf.start + step[1:3]
            crf.move = crf.move + step[3:].reshape(2, 2)
    crf.weights = crf.weights.astype(np.float32)
    return crf


def spotted(column: pa.Array, crf: Crf, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of each text, row and byte bounds of each offending word)."""
    tokens = Tokens(column)
    m = marginals(crf, tokens, tokens.features(p.slots))
    top = np.zeros(tokens.n_rows)
    np.maximum.at(top, tokens.rows, m)
    bad = np.flatnonzero(m >= p.span)
    rows = tokens.rows[bad]
    base = tokens.offsets[rows]
    return top, rows, np.stack([tokens.starts[bad] - base, tokens.ends[bad] - base], axis=1)


def spotted_long(column: pa.Array, crf: Crf, p: Params, piece: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``spotted`` of a column of one text, a few sentences at a time: sentences are scored apart, so the result is the same."""
    data, _ = text_buffer(column)
    top, pairs = np.zeros(1), [np.zeros((0, 2), dtype=np.int64)]
    for start, end in sentence_pieces(data, piece, ALNUM, MARKS):
        t, _, found = spotted(as_column(data[start:end]), crf, p)
        top = np.maximum(top, t)
        pairs.append(found + start)
    pairs = np.concatenate(pairs)
    return top, np.zeros(len(pairs), dtype=np.int64), pairs


def score(docs: DataFrame, crf: Crf, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (byte offsets start, end of each offending word) of each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                long = part.num_rows == 1 and len(text_buffer(part.column(1))[0]) > LONG
                top, rows, pairs = (spotted_long if long else spotted)(part.column(1), crf, p)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=part.num_rows) * 2)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(top), pa.ListArray.from_arrays(ends, pa.array(pairs.ravel().astype(np.int64)))], names=["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(run, "doc_id long, score double, spans array<long>")
    return out.select("doc_id", F.coalesce(fold("doc_id", p.folds) == p.held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"), "spans")
