"""The pipeline's stages on null and repeated ids, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "predicted", "stats", "label", "component_id", "n_shingles", "set_id", "block", "item", "start", "edits", "rate", "copy", "bucket"]
QUOTE = "nine quick brown foxes jump over every lazy dog that sleeps by the old river"
FAR = [" ".join(f"{stem}{k}" for k in range(60)) for stem in ("alpha", "beta", "gamma")]
ROWS = [
    (1, FAR[0]), (1, FAR[1]), (None, FAR[0]), (None, f"so {QUOTE} and more"), (2, f"so {QUOTE} and more"), (2, "clean words here only"),
    (3, None), (3, None), (4, ""), (None, None), (5, FAR[2]), (5, FAR[2]), (6, FAR[2] + " more"),
]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    labels = [(1, 1, 0), (2, 0, 0), (3, 0, 0), (5, 1, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, QUOTE), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "a", len(t or "")) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit(f"own {name}") for name in CLASHES}).repartition(3)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_copies(spark, docs, sf_dir):
    kept = corpus_pipeline.near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    want = [(1, FAR[0]), (1, FAR[1]), (2, f"so {QUOTE} and more"), (2, "clean words here only"), (3, None), (3, None), (4, ""), (None, None), (5, FAR[2])]
    assert pairs(kept) == sorted(want, key=repr)


def test_decontamination(spark, docs, sf_dir):
    kept = corpus_pipeline.decontamination(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert pairs(kept) == sorted([r for r in ROWS if QUOTE not in (r[1] or "")], key=repr)


def test_quality(spark, docs, sf_dir):
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    texts = {t for _, t in pairs(kept)}
    assert pairs(kept) == sorted([r for r in ROWS if r[1] in texts], key=repr)  # equal texts fare alike, whatever their ids


def test_mixing_and_output(spark, docs, sf_dir):
    mixed = corpus_pipeline.mixing(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and set(pairs(mixed)) <= set(ROWS)
    assert corpus_pipeline.token_output(spark, docs, sf_dir).count() == len(ROWS)


def test_empty_table(spark, docs, sf_dir):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).collect() == []
