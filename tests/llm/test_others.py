import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from moorline.llm import compression, crf, ecoc, hashtree, licenses, tiff, tokencounts
from moorline.llm.packing import encoder


@pytest.fixture(scope="module")
def big(spark):
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def big_docs(spark, big):
    return spark.read.parquet(f"{big}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, big):
    return spark.read.parquet(f"{big}/labels.parquet").cache()


# op1
def test_histogram_sums(spark, docs, no_docs):
    encode = encoder("byte_bpe_50k.tiktoken")
    n = [len(encode.encode_ordinary(r.text or "")) for r in docs.select("text").collect()]
    hist = tokencounts.histogram(tokencounts.token_lengths(docs)).cache()
    rows = {r.n_tokens: r for r in hist.collect()}
    assert sum(r.n_docs for r in rows.values()) == len(n)
    for length, r in rows.items():
        assert (r.n_docs, r.docs_at_most, r.tokens_at_most) == (n.count(length), sum(x <= length for x in n), sum(x for x in n if x <= length))
        assert (r.docs_longer, r.tokens_longer, r.tokens_truncated) == (sum(x > length for x in n), sum(x for x in n if x > length), sum(min(x, length) for x in n))
    for r in tokencounts.at_limits(hist, [0, 3, 8, 1000, 10**7]).collect():
        assert (r.docs_at_most, r.tokens_truncated) == (sum(x <= r.limit for x in n), sum(min(x, r.limit) for x in n))
    assert tokencounts.quantile(hist, 0.5).first().n_tokens == sorted(n)[-(-len(n) // 2) - 1]
    assert tokencounts.histogram(tokencounts.token_lengths(no_docs)).count() == 0


# op2
LICENCE = """Some code.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. Licensed under the Apache License, Version 2.0."""


def test_license_rules(spark, docs, no_docs):
    rows = [(1, LICENCE, "x"), (2, "Released under the MIT License.\nAll rights reserved.", "x"), (3, None, "x"), (4, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (got[1].licenses, got[2].licenses, got[3].licenses, got[4].licenses) == ("MIT,Apache-2.0", "MIT,All-Rights-Reserved", "", "")
    assert got[4].unmatched == "<mitnotice>" and got[3].n_sentences == 0
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(no_docs).count() == 0


# Those with an SQL form against it
@pytest.mark.parametrize("name", ["op2_license_sentences", "op3_superminhash", "op10_winnowing", "op11_gram_variants", "op12_bounded_codes", "op13_splitting_tree"])
def test_sql_forms(spark, sf_dir, name):
    from moorline.llm import queries

    assert_same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


# op4
def test_quality_held_out(spark, big_docs, labels):
    s = compression.score(big_docs, compression.fit(big_docs, labels)).join(labels, "doc_id").where("held_out")
    r = s.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.right > 0.95 and r.low >= 0 and r.high <= 1


def test_quality_edges(spark, docs, no_docs, labels):
    model = compression.fit(docs, labels)
    assert compression.score(docs, model).count() == docs.count() and compression.score(no_docs, model).count() == 0
    none = compression.fit(docs, labels.limit(0))
    assert {round(r.score, 3) for r in compression.score(docs, none).collect()} == {0.5}
    kept = compression.score(docs, none, carry=True)
    assert kept.columns == [*docs.columns, "quality_score"]


def test_scores_depend_on_text_alone(spark, big_docs, labels):
    model = compression.fit(big_docs, labels)
    a = compression.score(big_docs, model).select("doc_id", "score")
    b = compression.score(big_docs.withColumn("doc_id", F.col("doc_id") + 10_000_000).withColumn("lang", F.lit("zz")), model).select((F.col("doc_id") - 10_000_000).alias("doc_id"), F.col("score").alias("other"))
    assert a.join(b, "doc_id").where("score <> other").count() == 0


# op5
def test_language_held_out(big_docs):
    model = ecoc.fit(big_docs)
    assert model.languages == ["de", "en", "es", "fr"] and model.code.shape == (4, 7)
    p = ecoc.predict(big_docs, model).join(big_docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert p.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97


def test_language_edges(spark, docs, no_docs, big_docs):
    model = ecoc.fit(big_docs)
    got = {r.doc_id: r for r in ecoc.predict(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 11)) and got[10].lang_pred != "und"
    assert ecoc.predict(no_docs, model).count() == 0
    assert {r.lang_pred for r in ecoc.predict(docs, ecoc.fit(docs.where("lang is null"))).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_codewords_are_apart(n):
    code = ecoc.codewords(n)
    apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    assert apart >= (1 << (n - 2) if n <= 5 else 5)


# op6
def test_toxic_held_out(big_docs, labels):
    s = crf.score(big_docs, crf.fit(big_docs, labels)).join(labels, "doc_id").where("held_out").cache()
    assert s.where("toxic = 1").agg(F.avg("predicted")).first()[0] >= 0.9
    assert s.where("toxic = 0").agg(F.avg("predicted")).first()[0] < 0.05
    r = s.where("predicted = 1").select("doc_id", "spans").join(big_docs, "doc_id").first()
    raw = r.text.encode()
    assert r.spans and all(raw[a:b].decode().strip() for a, b in zip(r.spans[::2], r.spans[1::2], strict=True))


def test_toxic_edges(docs, no_docs, labels):
    model = crf.fit(docs, labels.limit(0))
    assert {r.predicted for r in crf.score(docs, model).collect()} == {0} and crf.score(no_docs, model).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, start, move = rng.normal(size=(1, 5)), rng.normal(size=2), rng.normal(size=(2, 2))
    total, ones = 0.0, np.zeros(5)
    for code in range(32):
        y = [code >> i & 1 for i in range(5)]
        w = np.exp(start[y[0]] + sum(e[0, i] for i in range(5) if y[i]) + sum(move[y[i], y[i + 1]] for i in range(4)))
        total += w
        ones += w * np.array(y)
    a, b, z = crf.forward_backward(e, np.ones((1, 5), dtype=bool), start, move)
    assert np.allclose(np.exp(z), total) and np.allclose(np.exp(a[0, :, 1] + b[0, :, 1] - z[0]), ones / total)


@pytest.fixture(scope="module")
def odd_texts(spark, docs, big_docs):
    rng = np.random.default_rng(3)
    words = ["Ab", "cd", "éfgh", "ijklmno", "Zo", "x", "quite", "数字", "longerword"]
    rows = [(i, " ".join(rng.choice(words, n)) + rng.choice([".", "!", "\n", ""])) for i, n in enumerate((1, 5, 63, 64, 65, 128, 129, 700, 3))]
    rows += [(100, "One two! three four?five six.\nseven"), (101, "a.b.c d"), (102, None), (103, ""), (104, "?!"), (105, "🤬 ok")]
    rows += [(1000 + r.doc_id, r.text) for r in big_docs.where("doc_id % 61 = 0").collect()]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_quality_equals_brute_force(odd_texts, big_docs, labels):
    """Own compressor loop, own features and own logistic over the model's dictionaries."""
    import math

    import zstandard

    m = compression.fit(big_docs, labels)
    boxes = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (m.good, m.bad)]
    text = {r.doc_id: (r.text or "").encode() for r in odd_texts.collect()}
    for r in compression.score(odd_texts, m).collect():
        raw = text[r.doc_id]
        d = c = s = 0.0
        if raw:
            good, bad = (sum(len(b.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096)) for b in boxes)
            d, c, s = (bad - good) / (bad + good), min(1.5, min(good, bad) / len(raw)), 1 / (1 + len(raw) / 256)
        d = 10 * max(-0.4, min(0.4, d))
        z = sum(w * x for w, x in zip(m.weights, (1.0, d, 2 * c, s, d * s, 2 * c * s)))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_equals_brute_force(odd_texts, big_docs):
    """Own n-gram loop over bytes and own loss-weighted decoder."""
    import math

    m = ecoc.fit(big_docs)
    bins, mask = m.p.bins, (1 << 64) - 1
    text = {r.doc_id: r.text for r in odd_texts.collect()}
    for r in ecoc.predict(odd_texts, m).collect():
        t = text[r.doc_id]
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in t.encode())
        count = {}
        for size in (1, 2, 3):
            for i in range(len(raw) - size + 1):
                gram = raw[i : i + size]
                if gram[0] == 32 and gram[-1] == 32:
                    continue
                code = 0
                for b in gram:
                    code = (code * 257 + b) & mask
                slot = ((code * 0x9E3779B97F4A7C15 + size & mask) >> 40) % bins
                count[slot] = count.get(slot, 0) + 1
        norm = math.sqrt(sum(count.values()))
        margins = [4 * (sum(math.sqrt(n) / norm * float(m.weights[s, b]) for s, n in count.items()) + float(m.bias[b])) for b in range(m.code.shape[1])]
        losses = [sum(float(m.trust[b]) * math.log1p(math.exp(-margins[b] * word[b])) for b in range(len(margins))) for word in m.code]
        shares = [math.exp(min(losses) - x) for x in losses]
        best = max(range(len(shares)), key=lambda k: shares[k])
        assert abs(r.score - shares[best] / sum(shares)) < 1e-4
        assert r.lang_pred == m.languages[best] or sorted(shares)[-2] > 0.999


def test_toxic_equals_brute_force(spark, odd_texts, big_docs, labels):
    """Own tokeniser and a plain chain, word by word, over whole sentences of any length."""
    import math
    import re

    m = crf.fit(big_docs, labels)
    rng = np.random.default_rng(1)
    m = crf.Crf(m.weights + rng.normal(0, 0.4, len(m.weights)).astype(np.float32), m.bias, m.start, m.move)  # so that scores lie everywhere
    text = {r.doc_id: r.text or "" for r in odd_texts.collect()}
    soft, words = {}, sorted({w for t in text.values() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t)})
    tokens = crf.Tokens(pa.array(words))
    soft = dict(zip(words, crf.Crf.emissions(m, tokens.features(crf.Params().slots)).tolist(), strict=True))
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))

    def chain(e):
        a = [[m.start[0], m.start[1] + e[0]]]
        for x in e[1:]:
            a.append([add(a[-1][0] + m.move[0, s], a[-1][1] + m.move[1, s]) + (x if s else 0.0) for s in (0, 1)])
        b = [[0.0, 0.0]]
        for x in e[:0:-1]:
            b.insert(0, [add(m.move[s, 0] + b[0][0], m.move[s, 1] + x + b[0][1]) for s in (0, 1)])
        z = add(*a[-1])
        return [math.exp(u[1] + v[1] - z) for u, v in zip(a, b, strict=True)]

    for r in crf.score(odd_texts, m).collect():
        t, top, spans, sentence = text[r.doc_id], 0.0, [], []
        found = list(re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", t))
        for i, w in enumerate(found):
            sentence.append(w)
            if i + 1 == len(found) or t[w.end()] in ".!?\n":
                for x, q in zip(sentence, chain([soft[y.group()] for y in sentence]), strict=True):
                    top = max(top, q)
                    if q >= 0.5:
                        spans.append((len(t[: x.start()].encode()), len(t[: x.end()].encode()), q))
                sentence = []
        assert abs(r.score - top) < 1e-6
        assert list(zip(r.spans[::2], r.spans[1::2], strict=True)) == [s[:2] for s in spans] or any(abs(s[2] - 0.5) < 1e-6 for s in spans)


# op7
@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000, 70_000])
def test_codecs_round_trip(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), bytes(n), rng.integers(97, 100, n, dtype=np.uint8).tobytes()):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data)) == data


def test_published_examples():
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_pages(spark):
    image = np.random.default_rng(0).integers(0, 256, (50, 70), dtype=np.uint8)
    schemes = [tiff.Scheme(c, p, t) for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for p in (1, 2) for t in (None, (32, 16))]
    data = tiff.write_tiff([(image, s) for s in schemes])
    big = struct.pack(">2sHI", b"MM", 42, 8) + struct.pack(">H", 8) + b"".join(struct.pack(">HHI", t, 3, 1) + struct.pack(">HH", v, 0) for t, v in ((256, 3), (257, 2), (258, 16), (259, 1), (277, 1), (278, 2))) + struct.pack(">HHII", 273, 4, 1, 110) + struct.pack(">HHII", 279, 4, 1, 12) + bytes(4) + struct.pack(">6H", *range(300, 306))
    files = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"nonsense")), (3, None), (4, bytearray(big)), (5, bytearray(data[:2000]))], "id long, content binary")
    rows = tiff.tiff_pages(files, "id", "content").collect()
    mine = [r for r in rows if r.id == 1]
    assert len(mine) == len(schemes) and all(bytes(r.samples) == image.tobytes() for r in mine)
    assert all(r.error for r in rows if r.id in (2, 3)) and any(r.error for r in rows if r.id == 5)
    other = next(r for r in rows if r.id == 4)
    assert np.frombuffer(bytes(other.samples), dtype=np.uint16).tolist() == list(range(300, 306))


def _directory(*tags):
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4) + bytes(64)


def test_broken_files_give_error_rows(spark):
    good = tiff.write_tiff([(np.arange(600, dtype=np.uint8).reshape(20, 30), tiff.Scheme(c, 1, t)) for c in (tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for t in (None, (16, 16))])
    base = [(256, 8), (257, 8), (258, 8), (259, 1)]
    bad = [
        _directory(*base, (322, 0), (323, 8), (324, 8), (325, 64)),  # a tile width of zero
        _directory((256, 1 << 30), (257, 1 << 30), (258, 8), (259, 1), (273, 8), (279, 16)),  # a huge page of a small strip
        _directory((256, 0), (257, 8), (258, 8), (259, 1), (273, 8), (279, 16)),
        _directory(*base, (273, 1 << 31), (279, 64)),  # a strip beyond the end
        _directory(*base, (278, 2), (273, 8), (279, 64)),  # too few strips
        struct.pack("<2sHI", b"II", 42, 1 << 30),
        b"II*", b"", b"MM\x00*",
    ]
    rng = np.random.default_rng(0)
    for _ in range(300):  # bytes changed at random, files cut anywhere
        x = bytearray(good)
        for at in rng.integers(0, 400 if rng.random() < 0.7 else len(x), rng.integers(1, 6)):
            x[at] = rng.integers(0, 256)
        bad.append(bytes(x[: len(x) if rng.random() < 0.7 else rng.integers(0, len(x))]))
    rows = tiff.tiff_pages(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(bad)], "id long, content binary"), "id", "content").collect()
    assert {r.id for r in rows} == set(range(len(bad)))
    assert all(r.error for r in rows if r.id < 9)


def test_text_media(docs, no_docs):
    rows = tiff.text_media(docs).collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        raw = text[r.doc_id]
        size = max(1, -(-len(raw) // 576)) * 576
        payload = raw + b"\xff" * (size - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(tiff.store(payload)).hexdigest()
    assert tiff.text_media(no_docs).count() == 0


# op8
def test_shards(spark, big_docs, docs, no_docs):
    rows = hashtree.shard_documents(big_docs).collect()
    text = {r.doc_id: (r.text or "").encode() for r in big_docs.collect()}
    slots = {}
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 8, zlib.crc32(text[r.doc_id]), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 10 < sum(r.grown_shard == 24 for r in rows) < 100
    assert hashtree.shard_documents(docs).count() == docs.count() and hashtree.shard_documents(no_docs).count() == 0


def test_weights_move_one_subtree(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    a, b = hashtree.Tree(), hashtree.Tree(weights={5: 3.0})
    x = keys.select(hashtree.descend(F.col("k"), a.root()).alias("a"), hashtree.descend(F.col("k"), b.root()).alias("b"))
    inside = F.col("b").between(0, 11) | F.col("a").between(0, 11)
    assert x.where((F.col("a") != F.col("b")) & ~inside).count() == 0
    counts = {r.b: r.n for r in x.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert 2.3 < counts[5] / counts[20] < 3.9


def test_slots_with_gaps_and_ties(spark):
    df = spark.createDataFrame([(i * 40_000 % 7_000_001, 0) for i in range(500)] + [(5, 0)] * 3 + [(None, 0)] * 2, "doc_id long, shard int")
    got = sorted(r.slot for r in hashtree.with_slots(df, "shard", "doc_id").collect())
    assert got == list(range(505))
