import hashlib
import random

import numpy as np
import pytest
from helpers import DOCS, contamination

from moorline.llm import winnow as W


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 7, 9, 10, 11, 25])))) for i in range(12)] + [(90, ""), (91, None), (92, "!!")]
    texts = []
    for _ in range(60):
        w = [word() if rng.random() < 0.5 else f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(80))]
        if rng.random() < 0.6:
            src = (rng.choice(items)[1] or "").upper().split()
            a = rng.randrange(len(src) + 1)
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.randrange(5, 16)]
        texts.append(", ".join(w))
    return list(enumerate(texts)) + [(900, None), (901, "")], items


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_hits_equal_brute_force(spark, most):
    texts, items = corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = W.contamination(docs, bench, W.Params(max_windows=most)).collect()
    assert len(rows) == len(texts)
    want = {d: contamination(t, items) for d, t in texts}
    assert any(w[1] for w in want.values())
    for r in rows:
        n, hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items, r.contaminated) == (n, hit, len(ids), ids, hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_shared_runs_share_a_fingerprint():
    """Winnowing's guarantee: equal runs of span words keep an equal gram, wherever they stand."""
    rng = np.random.default_rng(1)
    p = W.Params()
    for _ in range(50):
        shared = rng.integers(0, 50, p.span, dtype=np.uint64)
        kept = []
        for _ in range(2):
            text = np.concatenate([rng.integers(100, 10**6, rng.integers(0, 20), dtype=np.uint64), shared, rng.integers(100, 10**6, rng.integers(0, 20), dtype=np.uint64)])
            grams = W.ngram_hashes(text, p.k)
            kept.append(set(grams[W.winnow(grams, np.ones(len(grams), dtype=bool), p.window)].tolist()))
        assert kept[0] & kept[1]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_awkward_rows_and_empty_tables(spark, docs, no_docs, most):
    bench = spark.createDataFrame([(1, "repeat me twice please, thank you")], "item_id long, text string")
    p = W.Params(max_windows=most)
    rows = W.contamination(docs, bench, p).collect()
    assert len(rows) == docs.count() and sum(r.contaminated for r in rows) == 2
    assert {r.source for r in rows} == {"s", None}
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in W.contamination(docs, none, p).collect())
    assert W.contamination(no_docs, bench, p).count() == 0


def test_columns(docs, spark):
    assert set(DOCS.replace(",", "").split()[::2]) - {"text"} <= set(W.contamination(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).columns)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_items_without_an_id_count_as_hits(spark, most):
    """Null ids count in n_hit and contaminated, and are no item of their own."""
    text = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12"
    items = [(None, text), (None, "short one"), (None, None), (5, "z1 z2 z3")]
    texts = [(1, f"x {text} y"), (2, "say short one and z1 z2 z3"), (3, "say short one"), (4, "nothing here")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for only in (items, items[:3]):
        bench = spark.createDataFrame(only, "item_id long, text string")
        got = {r.doc_id: (r.n_hit, r.items, r.n_items, r.contaminated) for r in W.contamination(docs, bench, W.Params(max_windows=most)).collect()}
        named = [str(i) for i, _ in only if i]
        assert got == {1: (12, [], 0, True), 2: (2 + 3 * len(named), named, len(named), True), 3: (2, [], 0, True), 4: (0, [], 0, False)}
