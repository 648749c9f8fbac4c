"""Every operator over nulls, empty and repeated rows, ties, clashing columns and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gradewell.llm import (
    bloom_dedup,
    html_suffix,
    line_chunks,
    poisson_mix,
    ppm_language,
    qgram_decontam,
    rff_quality,
    seekable,
    set_join,
    url_templates,
)
from gradewell.llm.queries import RULES, TOKENIZER

LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(40_000))
DOCS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, "one two  three\tfour five six seven", "en", "a", 34),
    (3, "", "en", None, 0),
    (4, None, None, "b", None),
    (5, " \n\t", "de", "b", 3),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG, "en", "a", len(LONG)),
    (8, "ONE Two Three four five six seven", "fr", "a", 33),
    (9, "123 456", None, "c", 7),
    (9, "123 456", None, "c", 7),
    (None, "a row without an id", "en", "a", 19),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["score", "copy", "id", "sha", "word", "bits", "hash", "n", "rate", "size", "host", "start", "token", "block", "steps"]
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({name: F.lit(f"own {name}") for name in extra})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (6, 1, 1), (6, 0, 1), (99, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Five six seven."), (2, None), (3, ""), (4, "?!"), (1, "Five six seven.")], "item_id long, text string")


def test_exact_dedup(docs):
    got = {(r["doc_id"], r["text_sha256"]): r for r in bloom_dedup.exact_dedup(docs).collect()}
    assert len(bloom_dedup.exact_dedup(docs).collect()) == len(DOCS)
    sha = hashlib.sha256(b"one two three four five six seven").hexdigest()
    assert (got[1, sha]["keep_id"], got[1, sha]["group_size"], got[1, sha]["kept"]) == (1, 2, True)
    assert (got[2, sha]["keep_id"], got[2, sha]["kept"]) == (1, False)
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[3, empty]["group_size"], got[4, empty]["keep_id"]) == (2, 3)  # null counts as empty
    assert got[5, hashlib.sha256(b" ").hexdigest()]["group_size"] == 1
    assert got[9, hashlib.sha256(b"123 456").hexdigest()]["group_size"] == 2
    assert [r["kept"] for r in bloom_dedup.exact_dedup(docs).filter("doc_id is null").collect()] == [True]


def test_set_join(docs):
    rows = set_join.jaccard_components(docs).collect()
    assert len(rows) == len(DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[1] == (4, 1) and got[2] == (4, 1) and got[8] == (4, 1)
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5)
    assert got[6][1] == 6 and got[7][1] == 6 and got[9] == (1, 9)


def test_quality(docs, labels):
    rows = rff_quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(DOCS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert scores[3] == scores[4] and scores[6] == scores[7]
    assert {r["score"] for r in rff_quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_language(docs):
    rows = ppm_language.identify(docs).collect()
    assert len(rows) == len(DOCS)
    got = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [got[i] for i in (3, 4, 5, 9)] == ["und"] * 4 and got[6] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in ppm_language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixing(spark, docs):
    weights = spark.createDataFrame([("a", 1.0), ("b", None), ("c", -1.0), ("none", 5.0)], "source string, weight double")
    rows = poisson_mix.poisson_mix(docs, weights, epochs=4.0).collect()
    assert {r["source"] for r in rows} == {"a"} and rows[0]["rate"] == "own rate"
    assert {r["copy"] for r in rows if r["doc_id"] == 6} == set(range(1, 1 + max(r["copy"] for r in rows if r["doc_id"] == 6)))
    assert set(poisson_mix.poisson_mix(docs).columns) == set(docs.columns)


def test_decontamination(docs, benchmark):
    found = {(r["doc_id"], r["item_id"], r["edits"]) for r in qgram_decontam.find_leaks(docs, benchmark).collect()}
    assert found == {(1, 1, 0), (2, 1, 0), (8, 1, 0)}
    kept = qgram_decontam.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(DOCS) - 3
    assert qgram_decontam.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_token_files(docs):
    rows = seekable.token_files(docs, tokenizer()).orderBy("start").collect()
    assert len(rows) == len(DOCS)
    assert [r["doc_id"] for r in rows] == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]


def test_line_dedup(spark, docs):
    rows = line_chunks.line_dedup(docs).collect()
    assert len(rows) == len(DOCS) and all(r["n_removed"] == 0 for r in rows)
    assert {(r["doc_id"], r["text"]) for r in rows} == {(d[0], d[1]) for d in DOCS}
    assert [r["n_lines"] for r in rows if r["doc_id"] == 4] == [0]


PAGES = [
    (1, "https://WWW.Example.com/en/5?x", "<p>a &amp; b</p>"),
    (2, None, None),
    (3, "no host", ""),
    (4, "http://x.net", "<div>text"),
    (5, "http://x.net/es/", "<article><p>x<aside>y</aside>"),
    (5, "http://x.net/es/", "<article><p>x<aside>y</aside>"),
    (None, "http://a.b.example.com/en/#t", "<script>1</script>"),
]


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("own")).withColumn("path", F.lit("own"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_templates.judge_urls(pages, RULES).collect()}
    assert got == {
        1: ("www.example.com", "/en/5", "www.example.com/en/", "allow"),
        2: ("", "", None, "allow"),
        3: ("", "", None, "allow"),
        4: ("x.net", "", None, "allow"),
        5: ("x.net", "/es/", "net/es/", "block"),
        None: ("a.b.example.com", "/en/", "example.com/en/", "block"),
    }
    assert url_templates.judge_urls(pages, RULES).count() == len(PAGES)
    assert {r["verdict"] for r in url_templates.judge_urls(pages, []).collect()} == {"allow"}


def test_html(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_suffix.extract(pages).collect())
    assert got == [(0, "", 0), (1, "a & b", 5), (2, "", 0), (3, "", 0), (4, "text", 4), (5, "x", 1), (5, "x", 1)]


def test_empty_tables(spark, labels, benchmark):
    none = spark.createDataFrame([], SCHEMA)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for made in (
        bloom_dedup.exact_dedup(none),
        set_join.jaccard_components(none),
        rff_quality.quality_scores(none, labels),
        ppm_language.identify(none),
        poisson_mix.poisson_mix(none),
        qgram_decontam.find_leaks(none, benchmark),
        seekable.token_files(none, tokenizer()),
        line_chunks.line_dedup(none),
        url_templates.judge_urls(pages, RULES),
        html_suffix.extract(pages),
    ):
        assert made.collect() == []
