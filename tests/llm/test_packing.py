import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from moorline.llm import packing as P


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_json_vocabulary(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ["<|endoftext|> x", "数字 😀\n\n  a"]
    encode = P.encoder("byte_bpe_50k.tiktoken")
    assert [P.encode_text(encode, t).tolist() for t in texts] == reference_ids(texts)


def check(rows, texts, capacity=2048):
    """Every id in exactly one piece, pieces gapless in documents and in sequences, no padding, right checksums."""
    ids = {d: np.array([*x, 1], dtype="<u4") for d, x in zip(texts, reference_ids([t or "" for t in texts.values()]), strict=True)}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert set(docs) == set(ids)
    for d, parts in docs.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_round_trip(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    check(P.pack_documents(df.repartition(3)).collect(), texts)
    check(P.pack_documents(df.coalesce(1), P.Params(block=50)).collect(), texts)


def test_awkward_rows(spark, docs, no_docs):
    rows = P.pack_documents(docs).collect()
    assert sum(r.length for r in rows if r.doc_id == 5) == 1
    assert sum(r.length for r in rows if r.doc_id == 9) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 9)
    assert P.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_costs_are_balanced(seed):
    rng = random.Random(seed)
    p = P.Params(capacity=256, block=400)
    packer = P.Packer(p, 0)
    for d in range(399):
        packer.add(d, np.zeros(rng.randrange(1, 200), dtype="<u4"))
    packer.close()
    costs = defaultdict(float)
    fill = defaultdict(int)
    for _, _, n, _, s, _ in packer.out:
        costs[s] += packer.cost(n)
        fill[s] += n
    full = [costs[s] for s in costs if fill[s] == 256]
    assert max(full) <= 2 * min(full)


def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def special_texts():
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|endoftext|", " ", "\n\n", "don't", " a", "b ", "  ", "数字", "12", "|>"]
    return ["a <|endoftext|> b"] + ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(400)]


def test_special_tokens_in_texts(spark):
    texts = special_texts()
    want = plain_ids(texts)
    assert want[0] == [64, 220, 50256, 275]
    encode = P.encoder("byte_bpe_50k.tiktoken")
    assert [P.encode_text(encode, t).tolist() for t in texts] == want
    got = {r.doc_id: r.doc_tokens for r in P.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: len(x) + 1 for i, x in enumerate(want)}
    first = P.pack_documents(spark.createDataFrame([(0, texts[0])], "doc_id long, text string")).collect()
    ids = np.array([*want[0], 1], dtype="<u4")
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in first)


def test_lengths_count_special_tokens_once(spark):
    from moorline.llm.tokencounts import token_lengths

    texts = special_texts()
    rows = token_lengths(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(map(len, plain_ids(texts)))


def test_every_sequence_is_searched_for_room():
    """A piece is cut only where no sequence at all has room, however many cheaper ones are too full."""
    rng = random.Random(2)
    sizes = [rng.randrange(20, 72) for _ in range(60)]
    packer = P.Packer(P.Params(capacity=100, linear=0.0, quadratic=1.0, block=10**6), 0)
    for d, n in enumerate(sizes):
        packer.add(d, np.zeros(n, dtype="<u4"))
    packer.pack()
    bins = sum(sizes) // 100
    room, costs, whole = [100] * bins, [0.0] * bins, set()
    for d in sorted(range(len(sizes)), key=lambda d: -sizes[d]):
        fits = [b for b in range(bins) if room[b] >= sizes[d]]
        if fits:
            b = min(fits, key=lambda b: (costs[b], b))
            room[b] -= sizes[d]
            costs[b] += sizes[d] ** 2
            whole.add(d)
    cut = {r[0] for r in packer.out if r[2] < sizes[r[0]]} | {x[0] for x in packer.left}
    assert cut == set(range(len(sizes))) - whole
