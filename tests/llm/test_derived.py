"""op11, op12, op13 against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from moorline.llm import mixing as M
from moorline.llm import q_derived as Q
from moorline.llm import spelling as S
from moorline.llm import vectorcodes as V

# op11 --------------------------------------------------------------------------------------


def plain_words(rows, p):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % p.slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= p.shortest and n >= p.least}


def plain_variants(words, ratio=2):
    """Near words by way of all deletions, forms and roots one by one."""
    cuts = {}
    for w in words:
        for i in range(len(w)):
            cuts.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (_, short), group in cuts.items():
        for w in group:
            near[w] |= group - {w}
            if short in near:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        if best and -best[0] >= ratio * n:
            form[w] = best[1]
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def found(df):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def spelled(seed=1):
    """Words of few letters, so that many are near, with Latin-1 letters, long words and repeated rows."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(150)]
    long = "".join(rng.choice("abcd") for _ in range(40))
    for size in (9, 10, 11, 12):
        base += [long[:size], long[: size - 1] + "x", "y" + long[1:size]]
    rows = [(i, " ".join(rng.choice(base).capitalize() if rng.random() < 0.2 else rng.choice(base) for _ in range(60))) for i in range(60)]
    return rows + rows[:2] + [(None, "éaéaéa aaaaa, aaaaa"), (901, None), (902, ""), (903, "1 2 3"), (904, "AAAAA ÀÀÀÀÀÀ ÀÀÀÀÀÀ aaaab×÷ÿ")]


@pytest.mark.parametrize(("frequent", "whole", "most_broadcast"), [(1000, 256, 500_000), (3, 256, 500_000), (20, 10, 0), (1, 8, 0)])
def test_variants_equal_all_deletions(spark, frequent, whole, most_broadcast):
    p = S.Params(frequent=frequent, whole=whole, most_broadcast=most_broadcast, piece=50, held=20)
    rows = spelled()
    words = plain_words(rows, p)
    want = plain_variants(words)
    assert sum(1 for x in want.values() if x[0]) > 20 and any(len(w) > 10 for w in words)
    assert found(S.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), p)) == want


def test_near_words_share_a_list():
    """The bound's promise, without Spark: words one edit apart are indexed under a common gram, at most one place apart."""
    rng = random.Random(5)
    for frequent in (1, 5, 50):
        words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(5, 12))) for _ in range(80)]
        for w in words[:40]:
            i = rng.randrange(len(w) + 1)
            words += [w[:i] + "z" + w[i:], w[:i] + "a" + w[i + 1 :]]
        p = S.Params(frequent=frequent)
        counts = Counter(m[i : i + n] for m in map(S.marked, words) for n in range(p.q_min, p.q_max + 1) for i in range(len(m) - n + 1))
        lists = {w: set(S.indexed(w, lambda a, n, m=S.marked(w): c if (c := counts[m[a : a + n]]) > frequent else 0, p)) for w in words if len(w) >= p.shortest}
        for a, x in lists.items():
            for b, y in lists.items():
                if a != b and len(b) - len(a) in (0, 1) and near(a, b):
                    assert any(g == h and j - i in (0, len(b) - len(a)) for i, g in x for j, h in y), (a, b)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_spelling_without_words(spark, docs, no_docs):
    assert S.variants(no_docs).count() == 0
    assert S.variants(spark.createDataFrame([(1, None), (2, "a bc")], "doc_id long, text string")).count() == 0
    clash = docs.withColumn("word", docs.doc_id).withColumn("n", docs.doc_id).withColumn("gram", docs.doc_id)
    assert found(S.variants(clash)) == found(S.variants(docs))


def test_very_long_runs_and_texts(spark):
    run = "ab" * 40_000
    rows = [(i, f"{run} x{'é' * 300} {'é' * 299}") for i in range(4)] + [(9, "hello there " * 200_000)]
    p = S.Params(slips=10**9)
    got = found(S.variants(spark.createDataFrame(rows, "doc_id long, text string"), p))
    assert got == plain_variants(plain_words(rows, p)) and got["x" + "é" * 300][3] == 0 and got["hello"][2] == 200_000


# op12 --------------------------------------------------------------------------------------


def plain_codes(rows, p=V.Params()):
    """(rows of vec_id, code, error, label, books) by comparing each part with every entry in integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    width = -(-width // p.parts) * p.parts
    vecs = [[math.floor(x * p.scale) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    step = width // p.parts
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[: p.entries]
    books = [[vecs[r][i * step : (i + 1) * step] for r in first] for i in range(p.parts)]

    def assign():
        out = []
        for v in vecs:
            row = []
            for i, book in enumerate(books):
                part = v[i * step : (i + 1) * step]
                row.append(min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book)))
            out.append(row)
        return out

    for _ in range(p.rounds):
        got = assign()
        for i, book in enumerate(books):
            for j in range(len(book)):
                own = [v[i * step : (i + 1) * step] for v, row in zip(vecs, got, strict=True) if row[i][1] == j]
                if own:
                    book[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [(kept[r][0], "".join(f"{j:02x}" for _, j in row), sum(d for d, _ in row), kept[r][2]) for r, row in enumerate(assign())], books


def check_codes(df, rows, p=V.Params()):
    want, books = plain_codes(rows, p)
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    sums = Counter()
    for _, _, error, label in want:
        sums[label] += error
    cap = lambda x: min(x, (1 << 63) - 1)
    got = [tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=repr) == sorted(((i, c, cap(e), cap(sums[label]), sha) for i, c, e, label in want), key=repr)
    return got


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("first_b", [1, 4])
def test_codes_equal_plain_rounds(spark, first_b):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(int(i), (centres[rng.integers(20)] + 0.2 * rng.normal(size=16)).tolist(), None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(400)]
    rows += [(i, [0.25] * 16, 1) for i in range(500, 560)]  # one common vector
    rows += [(600, None, 1), (601, [None] * 16, 1), (602, [math.nan] * 16, 2), (603, [math.inf] + [0.0] * 15, 2), (None, [0.5] * 16, None), rows[0]]
    p = V.Params(first_b=first_b)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert len(check_codes(V.compressed(df, p), rows, p)) == 462
    assert V.fit(df, p).open_share[-1] < 0.5
    check_codes(V.compressed(df, p, most_labels=0), rows, p)


@pytest.mark.parametrize("scale", [1e3, 1e16])
def test_large_components_are_exact(spark, scale):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-scale, scale) for _ in range(8)], 0) for i in range(40)]
    check_codes(V.compressed(spark.createDataFrame(rows, SCHEMA)), rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)], [(3, [1.0, 2.0], None), (3, [1.0, 2.0], None), (2, [1.0] * 9, 1)]])
def test_few_and_ragged_vectors(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumns({"code": df.vec_id, "error": df.vec_id, "kind": df.vec_id})
    check_codes(V.compressed(clash), rows)


def test_bounds_leave_no_tie_to_chance():
    """Integer ties and equal entries, at every list length: bounds give what a full comparison gives."""
    rng = np.random.default_rng(0)
    for b in (1, 2, 3, 7, 15):
        books = rng.integers(-4, 5, (16, 3)).astype(float)
        x = rng.integers(-4, 5, (300, 3)).astype(float)
        held = V.Bounds.fresh(V.distances(x, books), b)
        for _ in range(8):
            new = books + rng.integers(-1, 2, books.shape) * (rng.random((16, 1)) < 0.4)
            held, _ = V.reassign(x, new, np.sqrt(((new - books) ** 2).sum(1)) * (1 + 1e-9), held, b := int(rng.integers(1, 16)), 1e-9)
            books = new
            d = V.distances(x, books)
            assert (held.code == d.argmin(1)).all()
            far = np.sqrt(d)
            assert (held.upper >= far[np.arange(300), held.code] * (1 - 1e-6)).all()
            for z in range(b):
                on = held.listed[:, z] != V.NONE
                assert (held.lower[on, z] <= far[np.flatnonzero(on), held.listed[on, z]] + 1e-9).all()


# op13 --------------------------------------------------------------------------------------


def plain_mix(rows, p=M.Params()):
    """Targets by sharing again and again, and what a line of words in the seeded order gives."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: p.weights[i % len(p.weights)] for i, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), float(sum(sizes.values()))
    open_ = set(order)
    while left > 1e-9 and open_:
        unit = left / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += unit * weight[s]
        left = sum(max(0.0, target[s] - p.most * sizes[s]) for s in open_)
        for s in [s for s in open_ if target[s] >= p.most * sizes[s]]:
            target[s] = float(p.most * sizes[s])
            open_.discard(s)
    out = []
    for s in order:
        left = min(math.floor(target[s] + 0.5), p.most * sizes[s])
        name = lambda r: (hashlib.md5(f"{p.seed}:{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest(), r[0] or 0)
        own = sorted((r for r in rows if r[2] == s), key=name)
        got = [0] * len(own)
        while left:
            for i, r in enumerate(own):
                n = min(left, size(r[1]))
                got[i] += n
                left -= n
        out += [(r[0], size(r[1]), sizes[s], round(target[s], 6), g) for r, g in zip(own, got, strict=True)]
    return sorted(out, key=repr)


def mixed(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


def sourced(seed=2):
    rng = random.Random(seed)
    source = lambda: rng.choice(["a"] * 8 + ["b", "B", "é", "", None, "zz"])
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(rng.randrange(30))), source()) for i in range(300)]
    return rows + [(500, "one two " * 3000, "b"), (501, None, "a"), (502, " \t\n", "empty"), (None, "x y", None), (None, "x y", None), rows[0], (7, "other text", "a")]


MIX = "doc_id long, text string, source string"


def test_mix_equals_a_line_of_words(spark):
    rows = sourced()
    p = M.Params(block=16, shard_blocks=20, bucket=10)
    df = spark.createDataFrame(rows, MIX)
    want = plain_mix(rows, p)
    assert mixed(M.taken(M.draw(df.repartition(3), p))) == want
    assert mixed(M.taken(M.draw(df.repartition(5, "source").withColumns({"shard": F_lit(1), "size": F_lit(2), "at": F_lit(3), "origin": F_lit(4)}), M.Params(block=64, shard_blocks=3, bucket=1000, most_broadcast=0)))) == want


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_shards_hold_exact_disjoint_blocks(spark):
    rows = sourced()
    p = M.Params(block=16, shard_blocks=20, bucket=10)
    df = spark.createDataFrame(rows, MIX)
    pieces = M.draw(df, p)
    sources = {r.rank: r for r in M.targets(M.measured(df, p), p).collect()}
    dealt = M.deal(M.targets(M.measured(df, p), p), p).collect()
    total = sum(r.quota for r in sources.values())
    n = -(-total // p.shard_blocks)
    assert n > 20
    by_shard, by_source = Counter(), {}
    for r in dealt:
        by_shard[r.shard] += r["last"] - r["first"]
        by_source.setdefault(r.rank, []).append((r["first"], r["last"]))
    assert [by_shard[i] for i in range(n)] == [(i + 1) * total // n - i * total // n for i in range(n)]
    for rank, spans in by_source.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == sources[rank].quota and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    # Written out: every piece's words stand in its text, shards are in shuffled order, and the words sum up.
    texts = dict((r[0], r[1]) for r in rows)
    got = M.texts(df, pieces, p).collect()
    assert sum(r.length for r in got) == sum(r.words for r in sources.values())
    last = {}
    for r in got:
        words = r.text.split(" ")
        assert len(words) == r.length
        if r.doc_id is not None and r.doc_id not in (7, 0):
            assert (texts[r.doc_id] or "").split()[r.start : r.start + r.length] == words
        assert last.get(r.shard, -(1 << 63)) <= r.place
        last[r.shard] = r.place


def test_hypergeometric_draws_have_the_right_odds(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(M.hypergeometric(F.lit(30).cast("long"), F.lit(12).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / 20_000, F.lit(0.5)).alias("x"))
    got = {r.x: r["count"] for r in df.groupBy("x").count().collect()}
    for k in range(11):
        want = math.comb(12, k) * math.comb(18, 10 - k) / math.comb(30, 10)
        assert abs(got.get(k, 0) / 20_000 - want) < 1e-3
    u = [(F.shiftrightunsigned(F.xxhash64("id", F.lit(i)), 11) + 0.5) / float(1 << 53) for i in (0, 1)]
    big = spark.range(20_000).select(M.hypergeometric(F.lit(10**11), F.lit(10**10), F.lit(5 * 10**10), *u).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(big[0] - 5e9) < 2000 and abs(big[1] - math.sqrt(5e10 * 0.1 * 0.9 * 0.5)) < 1500


def test_halves_add_up(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(M.split(F.array(*[F.lit(q).cast("long") for q in (50, 0, 7, 43)]), F.lit(40), [F.lit("s"), F.col("id")]).alias("x"))
    rows = [r.x for r in df.collect()]
    assert all(sum(x) == 40 and all(0 <= a <= b for a, b in zip(x, (50, 0, 7, 43), strict=True)) for x in rows)
    assert abs(sum(x[0] for x in rows) / 3000 - 20) < 0.2 and abs(sum(x[3] for x in rows) / 3000 - 17.2) < 0.2


def test_mix_of_nothing(spark, no_docs):
    assert M.taken(M.draw(no_docs)).count() == 0
    rows = [(1, None, None), (2, " ", "a")]
    assert mixed(M.taken(M.draw(spark.createDataFrame(rows, MIX)))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mix_stays_native(spark, sf_dir):
    plan = Q.op13_splitting_tree(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
