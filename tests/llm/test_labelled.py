"""What is learned does not depend on the order of rows; texts of any length are encoded."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from moorline.llm import compression, crf, ecoc, labelled
from moorline.llm.packing import encode_text, encoder


def test_ids_of_two_labels_teach_neither(spark):
    rows = [(i, i % 2) for i in range(60)] + [(i, 1 - i % 2) for i in range(0, 40)] + [(50, 0), (51, None), (None, 1)]
    got = []
    for order in (rows, rows[::-1]):
        ids = labelled.balanced_ids(spark.createDataFrame(order, "doc_id long, quality int").coalesce(1), "quality", 5, 0, 1000)
        got.append(sorted(tuple(r) for r in ids.collect()))
    assert got[0] == got[1] and {d for d, _ in got[0]} <= set(range(40, 60)) and all(y == d % 2 for d, y in got[0])


def texts(n):
    words = {"en": "the cat sat on a mat and so did we all", "de": "der hund lief durch den wald und kam nicht wieder"}
    return [(i, f"{i} " + " ".join(w for j, w in enumerate(words[lang].split() * 6) if (i + j) % 3), lang) for i in range(n) for lang in ("en", "de")]


def test_language_rows_are_learned_in_any_order(spark):
    """Every id stands for a text of each language: a text goes with its own row's lang."""
    rows, fits = texts(40), []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string").coalesce(1)
        fits.append(ecoc.fit(df))
        got = ecoc.predict(df, fits[-1], carry=True).collect()
        assert all(r.lang == r.lang_pred for r in got)
    assert np.array_equal(fits[0].weights, fits[1].weights)


def test_quality_and_toxicity_are_learned_in_any_order(spark):
    rows = [(i, t) for i, t, _ in texts(60)]
    labels = [(i, i % 2, i % 2) for i in range(60)] + [(i, 1 - i % 2, 1 - i % 2) for i in range(20)]
    found = []
    for a, b in ((rows, labels), (rows[::-1], labels[::-1])):
        docs = spark.createDataFrame(a, "doc_id long, text string").coalesce(1)
        lab = spark.createDataFrame(b, "doc_id long, quality int, toxic int").coalesce(1)
        q, t = compression.fit(docs, lab), crf.fit(docs, lab)
        found.append((q.good, q.bad, q.weights.tolist(), t.weights.tolist()))
    assert found[0] == found[1]


LONG = [
    " " * 3_000_000,
    "x" + "\n" * 3_000_000 + "y z",
    "\t" * 1_500_000 + " \n\u3000" * 500_000 + "end",
    "a  b" + " " * 1_200_000 + "<|endoftext|>" + " " * 1_200_000 + "<|endoftext|> tail" + "\r\n" * 600_000,
    "\x1c" * 1000 + " " * 200_000 + "\x1f.",
    " ".join("w" * (i % 9) + " " * (i % 7) for i in range(20_000)),
]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_long_white_space_gives_the_tokenizers_ids(text):
    json = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = encode_text(encoder("byte_bpe_50k.tiktoken"), text)
    assert got.tolist() == json.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 2_000_000, "7" * 2_000_000, "-" * 2_000_000, "é" * 1_000_000, "a1" * 1_000_000], ids=["letter", "digit", "mark", "accent", "mixed"])
def test_other_long_runs_do_not_crash(text):
    short = encode_text(encoder("byte_bpe_50k.tiktoken"), text)
    assert len(short) and encoder("byte_bpe_50k.tiktoken").decode(short.tolist()) == text


def test_long_texts_in_pieces_equal_whole_ones():
    """Counts of n-grams and marginals of sentences do not depend on where a long text is taken apart."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    words = ["abc", "défi", "the", "hund", "x1", "vile", "vileness", "日本", "a"]
    text = "".join(rng.choice(words) + rng.choice([" ", ", ", ". ", "!\n", "...", "?", "  "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]) for _ in range(4000))
    column = pa.array([text])
    for piece in (64, 1000, 1 << 20):
        assert np.array_equal(ecoc.long_shares(column, 512, piece), ecoc.shares(column, 512))
    p = crf.Params(slots=1 << 10)
    model = crf.Crf(rng.normal(size=p.slots).astype(np.float32), -1.0, np.array([0.2, -0.3]), np.array([[0.4, -0.5], [-0.2, 0.6]]))
    top, _, pairs = crf.spotted(column, model, p)
    assert len(pairs) > 50
    for piece in (16, 100, 5000, 1 << 20):
        t, _, found = crf.spotted_long(column, model, p, piece)
        assert np.allclose(t, top) and np.array_equal(found, pairs)
    for odd in ("", "no mark at all " * 50, "...", "a."):
        t, _, found = crf.spotted_long(pa.array([odd]), model, p, 8)
        whole = crf.spotted(pa.array([odd]), model, p)
        assert np.allclose(t, whole[0]) and np.array_equal(found, whole[2])
