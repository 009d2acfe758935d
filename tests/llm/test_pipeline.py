import corpus_pipeline as C
import pytest
from helpers import DOCS, components, contamination, shingles
from pyspark.sql import functions as F

from moorline.llm import compression, ecoc


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def test_stages_and_columns(spark, docs, sf_dir):
    assert [n for n, _ in C.STAGES] == ["quality", "language", "near_duplicates", "decontaminate", "packing"]
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema == docs.schema


def test_stages_equal_brute_force(spark, docs, sf_dir):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = compression.score(docs, compression.fit(docs, labels))
    assert ids(C.quality(spark, docs, sf_dir)) == ids(scored.where("predicted = 1"))
    named = ecoc.predict(docs, ecoc.fit(docs))
    assert ids(C.language(spark, docs, sf_dir)) == ids(named.where("lang_pred <> 'und'"))
    assert ids(C.near_duplicates(spark, docs, sf_dir)) == {d for d, (_, c) in components(rows).items() if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    near = {g for _, t in items for g in shingles(t, 3)}
    suspects = [(d, t) for d, t in rows if shingles(t, 3) & near]
    dirty = {d for d, t in suspects if contamination(t, items)[1]}
    assert dirty and ids(C.decontaminate(spark, docs, sf_dir)) == {d for d, _ in rows} - dirty


def test_run(spark, sf_dir, docs):
    out = C.run(spark, sf_dir)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < docs.count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_rows_without_ids_and_empty_tables(spark, sf_dir):
    rows = [(None, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (3, "x y z x y z q", "en", "s", 1), (3, "x y z x y z q", "en", "s", 1), (4, "x y z x y z q", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(str(r.doc_id) for r in C.near_duplicates(spark, df, sf_dir).collect()) == ["3", "None"]
    empty = spark.createDataFrame([], DOCS)
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_near_duplicates_go_by_row_not_by_id(spark, sf_dir):
    """Ids shared by different texts and rows without an id: one row of each group, and nobody else is dropped; rows without words all stay."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    near = lambda name: text(name) + " tail"
    rows = [
        (5, text("a")), (5, text("b")), (5, near("b")), (6, near("a")), (4, near("c")), (5, text("c")),
        (None, near("b")), (None, text("d")), (None, near("d")), (None, text("e")), (7, near("e")),
        (8, ""), (8, ""), (9, ""), (10, "  "), (10, "  "), (None, None), (None, None), (None, " "),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got = C.near_duplicates(spark, df, sf_dir).select("doc_id", "text").collect()
    words = lambda t: (t or "").split()[:1]
    full = sorted((r.doc_id or 0, words(r.text)[0]) for r in got if words(r.text))
    assert full == [(0, "d0"), (4, "c0"), (5, "a0"), (5, "b0"), (7, "e0")]
    assert next(r.text for r in got if r.doc_id == 5 and r.text.startswith("a0")) == text("a")
    assert sorted((str(r.doc_id), r.text or "-") for r in got if not words(r.text)) == sorted([("8", "-"), ("8", "-"), ("9", "-"), ("10", "  "), ("10", "  "), ("None", "-"), ("None", "-"), ("None", " ")])


CLASHING = "quality_score lang_pred lang_score ambiguous lettered own row bare contaminated n_words n_hit n_items items items_sha256 component_id kept n_shingles first _row _body score".split()


def test_clashing_columns(spark, docs, sf_dir):
    """Extra columns of any name pass through every filtering stage as they are."""
    few = docs.where("doc_id % 3 = 0")
    extra = few.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, extra, sf_dir)
        assert got.columns == extra.columns, name
        rows = got.collect()
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING), name
        assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, few, sf_dir).select("doc_id").collect()}, name
    assert C.pack(spark, extra, sf_dir).count() == C.pack(spark, few, sf_dir).count()
