import random

import numpy as np
import pyarrow as pa
from helpers import DOCS, components, shingles

from moorline.llm import minhash as M
from moorline.llm.components import connected_components


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(seed, words, copies, edits):
    """A text and copies with some words changed."""
    rng = random.Random(seed)
    base = [f"a{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"b{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_groups_equal_brute_force(spark):
    texts = [t for s in range(12) for t in family(s, 90, 14, 8)]
    rng = random.Random(9)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = M.near_duplicates(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS).repartition(5))
    assert got(df) == components(rows)


def test_large_group_needs_the_last_step(spark):
    """Copies far from each other but near one centre, in buckets larger than the all-pairs limit."""
    rows = list(enumerate(family(77, 200, 60, 12)))[::-1]
    p = M.Params(small_bucket=3, pivots=1, deal=8)
    df = M.near_duplicates(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS), p)
    assert got(df) == components(rows)


def test_rare_pairs_miss_none(spark):
    """Texts of one common passage and own words, some near each other: all near pairs of different components are met, few others."""
    rng = random.Random(4)
    shared = [f"c{i}" for i in range(80)]
    texts = []
    for g in range(30):
        own = [f"o{g}x{i}" for i in range(rng.randrange(18, 40))]
        for _ in range(3):
            w = shared + own
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    comp = [i // 2 for i in range(len(texts))]
    near = {
        (i, j)
        for j in range(len(texts))
        for i in range(j)
        if comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    }
    assert near
    df = spark.createDataFrame([(i, comp[i], t) for i, t in enumerate(texts)], "id long, comp long, text string").repartition(4)
    for p in (M.Params(), M.Params(places=64, deal=4)):
        found = {(r.u, r.v) for r in M.rare_pairs(df, p).collect()}
        assert near <= found and all(comp[u] != comp[v] for u, v in found)
    passages = [" ".join([f"c{i}" for i in range(76)] + [f"p{g}q{i}" for i in range(24)]) for g in range(40)]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(passages)], "id long, comp long, text string")
    assert M.rare_pairs(df, M.Params()).isEmpty()


def test_last_step_keeps_borderline_pairs(spark):
    """Pairs at similarity 0.75 to 0.8 in large buckets of other texts that share a passage: groups equal brute force."""
    rng = random.Random(11)
    shared = [f"c{i}" for i in range(90)]
    rows = []
    for g in range(60):
        own = [f"o{g}x{i}" for i in range(40)]
        twin = own[:20] + [f"t{g}x{i}" for i in range(rng.randrange(12, 20))]
        rows += [" ".join(shared + own), " ".join(shared + twin)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS).repartition(3)
    want = components(rows)
    assert 60 < len({c for _, c in want.values()}) < 120
    assert got(M.near_duplicates(df, M.Params(small_bucket=3, pivots=1))) == want


def test_awkward_rows(docs):
    rows = M.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1 and by[1].kept and not by[2].kept
    assert by[4].n_shingles == by[5].n_shingles == by[6].n_shingles == 0 and by[5].component_id == 5 and by[5].kept
    assert by[8].component_id == 7
    assert by[3].n_shingles == 1 and by[3].kept
    assert by[None].component_id is None and not by[None].kept
    assert sum(r.doc_id == 9 and r.kept for r in rows) == 2


def test_empty_table(no_docs):
    assert M.near_duplicates(no_docs).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for n, share in ((40, 0.8), (400, 0.75), (5000, 0.6)):
        a = rng.integers(1, 2**63, n, dtype=np.uint64)
        b = a.copy()
        k = int(n * (1 - share) / (1 + share))
        b[:k] = rng.integers(1, 2**63, k, dtype=np.uint64)
        owner = np.repeat([0, 1], n)
        s = M.superminhash(np.concatenate([a, b]), owner, 2, 256)
        true = (n - k) / (n + k)
        assert np.isfinite(s).all() and abs((s[0] == s[1]).mean() - true) < 0.12
        alone = M.superminhash(a[::-1], np.zeros(n, dtype=np.int64), 1, 256)
        assert (alone[0] == s[0]).all()


def test_shingle_sets_do_not_cross_rows():
    h, owner = M.shingle_sets(pa.array(["a b c d e", "f g", None, "a b c d e f", "a  B\tc\nd e"]), 5)
    assert np.bincount(owner, minlength=5).tolist() == [1, 1, 0, 2, 1]
    assert set(h[owner == 0]) == set(h[owner == 4]) < set(h[owner == 3])


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "u long, v long").repartition(7)
    rows = {r.id: r.component_id for r in connected_components(edges).collect()}
    assert rows == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_rows_link_by_text_not_by_id(spark):
    """Ids repeated under other texts, and null ids: every row is linked by its own text."""
    texts = family(5, 120, 3, 4) + family(6, 120, 3, 4) + ["lonely words that nobody else has used here"]
    ids = [40, 7, None, 30, 7, 8, None, 9, 7]
    rows = list(enumerate(texts))
    by_row = components(rows)
    smallest = {}
    for i, (_, c) in by_row.items():
        smallest.setdefault(c, []).append(ids[i])
    want = sorted((str(ids[i]), n, min((x for x in smallest[c] if x is not None), default=None)) for i, (n, c) in by_row.items())
    df = spark.createDataFrame([(ids[i], t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got_rows = M.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got_rows) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got_rows)


def test_class_in_many_pairs(spark):
    """A central text copied for every few pairs gives the same groups."""
    rows = list(enumerate(family(3, 150, 40, 6)))
    p = M.Params(small_bucket=3, share=4, bitmap_bits=1 << 15)
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    assert got(M.near_duplicates(df, p)) == components(rows)
