"""Cases that an operator once did only in part."""

import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from gradewell.llm import html_suffix, ppm_language, queries, set_join
from tests.llm.test_brute_force import brute_components, shingles


def test_pipeline_drops_copies_with_a_fifth_added(spark):
    base = [f"w{k}" for k in range(100)]
    texts = {1: base, 2: base + [f"more{k}" for k in range(22)], 3: base + [f"far{k}" for k in range(30)], 4: [f"own{k}" for k in range(50)]}
    texts = {k: " ".join(words) for k, words in texts.items()}
    sets = {k: shingles(text, 5) for k, text in texts.items()}
    near = {k: 100 * len(sets[1] & sets[k]) >= 80 * len(sets[1] | sets[k]) for k in texts}
    assert near == {1: True, 2: True, 3: False, 4: False}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3, 4]


@pytest.fixture()
def as_table(spark, tmp_path):
    """A folder with the given rows as a table, for a query."""

    def made(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return made


def prose(rng, words):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(words))


def test_line_dedup_removes_passages_of_few_lines(spark, as_table):
    rng, rows, want = random.Random(6), [], {}
    for n in (1, 3, 5):
        passage = [prose(rng, 51) for _ in range(n)]
        for copy in range(8):
            before, after = ([prose(rng, rng.choice((3, 40, 70))) for _ in range(rng.randrange(4))] for _ in range(2))
            doc = 100 * n + copy
            rows.append((doc, "\n".join(before + passage + after)))
            want[doc] = ("\n".join(before + passage * (copy == 0) + after), n * (copy > 0))
    line = prose(rng, 50)  # not over 50 words: stays
    for doc in (901, 902):
        rows.append((doc, f"start {doc}\n{line}\nend {doc}"))
        want[doc] = (rows[-1][1], 0)
    got = queries.op7_line_dedup(spark, as_table("documents", rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got} == want


def test_line_dedup_keeps_the_first_of_every_line(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id")
    got = {r["doc_id"]: r for r in queries.op7_line_dedup(spark, "/root/testdata/sf0.01").collect()}
    seen, left = set(), set()
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        lines, kept = text.split("\n"), got[doc]["text"].split("\n")
        assert got[doc]["n_removed"] == len(lines) - len(kept) or (got[doc]["n_removed"], kept) == (len(lines), [""])
        for line in kept:
            assert len(line.split()) <= 50 or line not in seen
        seen |= set(lines)
        left |= set(kept)
    assert seen <= left


def test_html_decides_for_the_whole_host(spark):
    """Boilerplate on few pages of a host of many shards goes as it does in one suffix array."""
    rng, rows = random.Random(8), []
    few = [prose(rng, 9) for _ in range(30)]
    for page in range(120):
        body = [prose(rng, 12)] + ([few[page % 30]] if page < 90 else []) + [prose(rng, rng.randrange(1, 12))]
        rng.shuffle(body)
        blocks = "".join(f"<div>{x}</div>" for x in body)
        blocks = f"<main><p>own {page}</p></main>{blocks}" if page % 30 in (3, 4) and page >= 60 else blocks
        rows.append((page, f"http://{'big' if page % 40 else 'small'}.org/{page}", f"<body>{blocks}</body>"))
    rows += [(500 + k, "http://big.org/same", f"<div>{few[0]}</div>") for k in range(2)] + [(600, "http://big.org/", None), (601, "http://big.org/", "")]
    rows += [(700 + k, "http://closed.org/", f"<article>text {k}</article><div>{few[1]}</div>") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, dealt = ({r["page_id"]: r["text"] for r in html_suffix.extract(pages, shard=n).collect()} for n in (1000, 5))
    assert len(dealt) == len(rows) and dealt == whole
    gone = sum(few[k % 30] in html and few[k % 30] not in dealt[k] for k, _, html in rows[:90])
    assert gone > 70


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="page has-sidebar"><p>one two</p><div class="sidebar">x</div></div>', "one two"),
        ('<div class="page has-sidebar"><article><p>one two</p></article><div id="sidebar">x</div></div>', "one two"),
        ('<div class="page sidebar"><article><p>one two</p></article></div>', "one two"),
        ('<article><header class="entry-header"><h1>Title</h1></header><p>text</p></article>', "Title\n\ntext"),
        ('<main><p class="related-work">keep</p><section id="share-prices">too</section><ul class="comment-list"><li>no</li></ul></main>', "keep\n\ntoo"),
        ('<article><p>text</p><article><p>nice!</p></article></article>', "text"),
        ('<article>text here</article><div class="comments"><article>I agree</article></div>', "text here"),
        ('<body><p>the main text stands here, outside of the</p><article>teaser</article></body>', "the main text stands here, outside of the\n\nteaser"),
        ('<div class="widget"><p>all that there is</p></div>', "all that there is"),
        ('<main><p>a</p><div class="ad-slot">buy</div><div class="site-footer">c</div><aside>d</aside></main>', "a"),
    ],
)
def test_html_names_never_cost_the_article(page, want):
    assert html_suffix.main_texts([html_suffix.page_blocks(page)]) == [want]


def test_html_host_decides_on_pages_without_article(spark):
    """The suffix array takes what pages share and leaves what they don't, teasers and all."""
    rng, rows, want = random.Random(3), [], {}
    notice = prose(rng, 12)
    for page in range(40):
        own, teaser = prose(rng, 30), prose(rng, 9)
        rows.append((page, "http://host.org/x", f"<body><div>{notice}</div><p>{own}</p><article>{teaser}</article></body>"))
        want[page] = f"{own}\n\n{teaser}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (1000, 7):
        assert {r["page_id"]: r["text"] for r in html_suffix.extract(pages, shard=shard).collect()} == want


def test_html_of_very_long_pages():
    text = "word " * 200_000
    page = f"<nav>{text}</nav><article>" + f"<p>{text}</p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>"
    assert html_suffix.main_texts([html_suffix.page_blocks(page)]) == [f"{text.strip()}\n\ndeep"]


def test_context_trees_of_a_hundred_languages():
    """The model grows with what was learned, and texts go to their own language."""
    rng, texts = random.Random(9), {}
    for lang in range(100):
        letters = [chr(rng.choice((97, 0x400, 0x4E00, 0xAC00)) + rng.randrange(400)) for _ in range(12)]
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(40)]
        texts[f"l{lang:03d}"] = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    counts = pd.concat(ppm_language.counts_of([t.encode() for t in found[:9]]).assign(lang=lang) for lang, found in texts.items())
    trees = ppm_language.grow(counts.groupby(["lang", "order", "key"], as_index=False)["n"].sum())
    coder = ppm_language.Coder(trees)
    for lang, found in texts.items():
        for text in found[9:]:
            assert trees.languages[int(np.argmin(coder.lengths(text.encode())))] == lang
    contexts, dense = len(trees.shorter), len(trees.shorter) * 256 * 100 * 4
    assert contexts > 3000 and trees.bits.nbytes + trees.cell.nbytes + trees.escape.nbytes < dense / 20


def test_set_join_of_very_long_documents(spark, monkeypatch):
    """Blocks hold few sets where these are large, and no link is lost by it."""
    monkeypatch.setattr(set_join, "BLOCK_TOKENS", 500)
    rng, rows = random.Random(10), []
    for group in range(12):
        base = [f"g{group}w{k}" for k in range(rng.choice((40, 400)))]
        for copy in range(6):
            words = list(base)
            for _ in range(copy * len(base) // 400):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            rows.append((100 * group + copy, " ".join(words)))
    got = set_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(dict(rows))
