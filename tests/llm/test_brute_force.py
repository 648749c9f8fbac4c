"""Operators against brute force, exact round trips or held-out accuracy on the small tables."""

import html
import math
import random
import time
import re
import struct
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradewell.llm import html_suffix, line_chunks, poisson_mix, ppm_language, qgram_decontam, queries, rff_quality, seekable, set_join
from gradewell.llm.common import components

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def shingles(text, size=4):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text.encode().lower()) if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(texts, size=4, percent=85):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies():
    """Clusters whose members lie around the threshold, and chains through them."""
    rng, texts = random.Random(3), {}
    for cluster in range(4):
        base = [f"c{cluster}w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(90):
            texts[len(texts)] = edited(base, rng.randrange(7), rng)
        chain = base
        for _ in range(15):
            chain = edited(chain, 2, rng).split(" ")
            texts[len(texts)] = " ".join(chain)
    return texts


def test_set_join(spark, docs):
    for texts in (dict(zip(docs.doc_id, docs.text, strict=True)), near_copies()):
        made = spark.createDataFrame([*texts.items()], "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in set_join.jaccard_components(made).collect()}
        assert got == brute_components(texts)


def test_set_join_small_blocks(spark, monkeypatch):
    """Many blocks and pieces of lists, so that links have to be found across them."""
    monkeypatch.setattr(set_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(set_join, "PIECE", 4)
    texts = near_copies()
    made = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in set_join.jaccard_components(made).collect()}
    assert got == brute_components(texts)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(80)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for node in sorted(near):
        todo = [] if node in want else [node]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = node
                todo += near[x]
    loose = {a for a, b in edges if a == b and near[a] == {a}}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k not in loose}


def test_poisson_counts(spark, docs):
    frame = spark.createDataFrame(docs)
    rates = {r["source"]: r for r in poisson_mix.source_rates(frame).collect()}
    sizes = docs.assign(size=docs.text.str.len()).groupby("source")["size"].sum()
    for source, size in sizes.items():
        want = sizes.sum() * math.sqrt(size) / np.sqrt(sizes).sum() / size
        assert rates[source]["rate"] == pytest.approx(want)
    draws = {r["doc_id"]: r["u"] for r in frame.select("doc_id", poisson_mix.draw("doc_id", "text", poisson_mix.SEED).alias("u")).collect()}
    want = Counter()
    for row in docs.itertuples():
        rate, k = rates[row.source]["rate"], 0
        p = total = math.exp(-rate)
        while total <= draws[row.doc_id]:
            k += 1
            p *= rate / k
            total += p
        want[row.doc_id] = k
    rows = queries.queries()["op3_poisson_mix"](spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == +want
    order = [r["doc_id"] for r in rows]
    assert order != sorted(order) and abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3


def test_poisson_steps():
    for rate in (0.3, 2.0, 900.0):
        steps = np.array(poisson_mix.poisson_steps(rate))
        mean = (1 - steps).sum()
        assert mean == pytest.approx(rate, rel=1e-6) and steps[-1] == pytest.approx(1)


def test_quality_held_out(spark):
    rows = queries.queries()["op4_rff_quality"](spark, SF_MORE).toPandas()
    for r in rows.head(50).itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = rows[rows.held_out].merge(pd.read_parquet(f"{SF_MORE}/labels.parquet"), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.97
    labels = spark.read.parquet(f"{SF_MORE}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = rff_quality.quality_scores(spark.read.parquet(f"{SF_MORE}/documents.parquet"), flipped, learn=queries.crc_share("doc_id", 3) != 1).toPandas()
    both = rows.merge(again, on="doc_id")
    assert np.allclose(both.score_x, both.score_y, atol=1e-6)  # held-out labels change nothing


def test_pool_adjacent():
    rng = np.random.default_rng(0)
    values, weights = rng.normal(size=12), rng.integers(1, 5, 12).astype(float)
    got = rff_quality.pool_adjacent(values, weights)
    for k in range(12):  # min-max formula
        want = max(min(np.average(values[i : j + 1], weights=weights[i : j + 1]) for j in range(k, 12)) for i in range(k + 1))
        assert got[k] == pytest.approx(want)


def test_language_held_out(spark):
    rows = queries.queries()["op9_ppm_language"](spark, SF_MORE).toPandas()
    held = rows[rows.held_out].merge(pd.read_parquet(f"{SF_MORE}/documents.parquet"), on="doc_id")
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_code_lengths(docs):
    texts = [t.encode() for t in docs.text.head(40)]
    counts = pd.concat(ppm_language.counts_of(texts[k::2]).assign(lang=f"l{k}") for k in range(2))
    trees = ppm_language.grow(counts.groupby(["lang", "order", "key"], as_index=False)["n"].sum())
    for row in range(len(trees.shorter)):  # a code at every node
        assert np.allclose(np.exp2(-trees.row_bits(row).astype(float)).sum(axis=0), 1, atol=1e-3)
    coder = ppm_language.Coder(trees)
    for text in (texts[0][:2000], b"a", b"ab", "ñß".encode()):
        assert coder.lengths(text) == pytest.approx([ppm_language.code_length(text, trees, x) for x in trees.languages], rel=1e-5)


def test_decontamination(spark):
    rng = random.Random(2)
    documents, bench = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")
    planted, rows = {}, []
    for item, text in zip(bench.item_id, bench.text, strict=True):
        chars = list(text)
        for _ in range(int(len(text) * 0.02)):
            chars[rng.randrange(len(chars))] = rng.choice("abcdefgh")
        key = 10**6 + item
        planted[key] = item
        rows.append((int(key), f"{documents.text[int(item) % 100]} {''.join(chars)} {documents.text[int(item) % 90]}"))
    plain = [(int(i), t) for i, t in zip(documents.doc_id, documents.text, strict=True)]
    frame = spark.createDataFrame(plain + rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in qgram_decontam.find_leaks(frame, spark.createDataFrame(bench)).collect()}
    assert {(k, v) for k, v in planted.items()} <= set(found)
    exact = {(i, j) for i, t in plain for j, x in zip(bench.item_id, bench.text, strict=True) if qgram_decontam.normal(x) in qgram_decontam.normal(t)}
    ids = dict(plain)
    assert exact <= {k for k in found if k[0] in ids}
    for (doc, item), row in list(found.items())[:40]:  # every find holds by brute force
        text = qgram_decontam.normal(dict(plain + rows)[doc])[row["start"] : row["end"]]
        x = qgram_decontam.normal(bench.text[bench.item_id == item].iloc[0])
        target = min(len(x), qgram_decontam.PASSAGE)
        assert min(substring_distance(x[s : s + target], text) for s in range(len(x) - target + 1)) <= row["edits"] <= qgram_decontam.budget(target)


def edit_distance(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def substring_distance(a, b):
    """Least edits between the whole of a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row)


def test_aligned_run():
    """The best run of the item against all runs and parts of the text."""
    rng = random.Random(5)
    for _ in range(150):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(8, 20)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 24)))
        target = rng.randrange(3, len(item) + 1)
        want = min(substring_distance(item[s : s + target], text) for s in range(len(item) - target + 1))
        a, b = map(qgram_decontam.code_points, (item, text))
        wide = (-len(item) - 8, len(item) + len(text) + 16)
        got = qgram_decontam.aligned_run(a, b, *wide, target, 20)
        assert got[0] == want
        assert min(edit_distance(item[s : s + target], text[got[1] : got[2]]) for s in range(len(item) - target + 1)) == want
        assert qgram_decontam.aligned_run(a, b, *wide, target, want - 1) is None if want else True


def quotes():
    """(item texts, their index, a maker of other text)."""
    bench = pd.read_parquet("/root/testdata/sf0.1/benchmark.parquet")
    rng = random.Random(12)
    other = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(30))
    index = qgram_decontam.index_of(list(zip(bench.item_id, bench.text, strict=True)))
    return [(i, qgram_decontam.normal(t)) for i, t in zip(bench.item_id, bench.text, strict=True)], index, other, rng


def test_quotes_are_found_wherever_they_begin():
    items, index, other, rng = quotes()
    for item, text in items:
        for length in (120, 121, 135, 150, 178, 200):
            if length <= len(text):
                at = rng.randrange(len(text) - length + 1)
                found = qgram_decontam.leaks(f"{other()} {text[at : at + length]} {other()}", index)
                assert item in {i for i, _, _, edits in found if edits == 0}
        if len(text) > 200:  # shorter quotes than a passage are none
            found = qgram_decontam.leaks(f"{other()} {text[50:140]} {other()}", index)
            assert item not in {i for i, *_ in found}


def test_edited_quotes_against_brute_force():
    items, index, other, rng = quotes()
    held = set()
    for item, text in rng.sample([x for x in items if len(x[1]) > 130], 40):
        at = rng.randrange(len(text) - 120 + 1)
        chars = list(text[at : at + 120])
        for k in rng.sample(range(120), rng.randrange(1, 12)):
            chars[k] = rng.choice(["", "q", chars[k] + "z", chars[k]])
        document = qgram_decontam.normal(f"{other()} {''.join(chars)} {other()}")
        want = min(substring_distance(text[s : s + 120], document) for s in range(max(0, at - 8), min(len(text) - 119, at + 9)))
        got = {i: edits for i, _, _, edits in qgram_decontam.leaks(document, index)}.get(item)
        assert got == (want if want <= 6 else None)
        held.add(got is None)
    assert held == {True, False}


def test_periodic_texts_end_soon():
    for document, item, want in (
        ("a" * 100_000, "a" * 300, (0, 120, 0)),
        ("a" * 100_000, "a" * 60 + "b" + "a" * 100, (0, 119, 1)),
        ("ab" * 50_000, "ab" * 70 + "c" + "ab" * 70, (0, 120, 0)),
    ):
        begin = time.process_time()
        assert qgram_decontam.leaks(document, qgram_decontam.index_of([(1, item)])) == [(1, *want)]
        assert time.process_time() - begin < 20


def test_gram_hashes():
    text = "abcabcabcdefabcabcabcdxy"
    hashes = qgram_decontam.gram_hashes(qgram_decontam.code_points(text))
    grams = [text[i : i + qgram_decontam.Q] for i in range(len(text) - qgram_decontam.Q + 1)]
    assert len(hashes) == len(grams)
    assert [(a == b) for a in grams for b in grams] == [(a == b) for a in hashes for b in hashes]


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = queries.public_tokenizers.path(queries.TOKENIZER)
    odd = "  Café naïve x y 'S don't İSTANBUL ΣΑΣ <|endoftext|> é\x1c 日本語 \x85 ½"
    rows = [(int(i), t) for i, t in zip(docs.doc_id, docs.text, strict=True)] + [(10**6, odd)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    listed = seekable.write_tokens(frame, f"{tmp_path}/files", path)
    got = {r["doc_id"]: r for r in seekable.read_tokens(listed, f"{tmp_path}/files").collect()}
    tokenizer, start = Tokenizer.from_file(path), 0
    for doc, text in sorted(rows):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert bytes(got[doc]["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert (got[doc]["start"], got[doc]["n_tokens"]) == (start, len(ids))
        start += len(ids)
    # one document is read alone; damage is seen; any zstandard reader takes the file as a whole
    name = f"{tmp_path}/files/{listed.first()['file']}"
    raw = bytearray(open(name, "rb").read())
    with open(name, "rb") as file:
        entries = seekable.seek_table(file)
        assert seekable.frame_ids(file, entries[1]) == bytes(got[int(entries[1]["id"])]["ids"])
    import io

    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(raw)), read_across_frames=True).read()
    assert whole == b"".join(bytes(got[int(e["id"])]["ids"]) for e in entries)
    raw[int(entries[1]["at"]) + 9] ^= 255
    with pytest.raises(ValueError):
        seekable.frame_ids(io.BytesIO(bytes(raw)), entries[1])
    raw[-30] ^= 255
    with pytest.raises(ValueError):
        seekable.seek_table(io.BytesIO(bytes(raw)))


def test_line_dedup(spark, docs):
    block = "\n".join(f"shared line {k}" for k in range(40))
    texts = dict(zip(docs.doc_id.astype(int), docs.text, strict=True))
    for k in range(30):
        texts[5000 + k] = f"own start {k}\n" * (k % 3) + f"{block}\nown end {k}\nmore {k}"
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    cut = frame.select("doc_id", line_chunks.line_chunks(F.col("text")).alias("c")).collect()
    chunks = {r["doc_id"]: [(c["seq"], c["first"], c["last"], c["body"]) for c in r["c"]] for r in cut}
    seen, want = {}, {}
    for doc in sorted(texts):
        assert "\n".join(c[3] for c in chunks[doc]) == texts[doc]
        kept, removed = [], 0
        for seq, first, last, body in chunks[doc]:
            if last > first and body.strip() and seen.setdefault(body, (doc, seq)) != (doc, seq):
                removed += last - first + 1
            else:
                kept.append(body)
        want[doc] = ("\n".join(kept), removed)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_chunks.line_dedup(frame).collect()}
    assert got == want
    assert sum(got[5000 + k][1] >= 2 for k in range(1, 30)) == 29  # shifted copies are found


def article(page):
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", found[1] if found else "")
    plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n\n".join(p for p in plain if p)


def test_html(spark):
    pages = pd.read_parquet(f"{SF_MORE}/pages.parquet")
    got = queries.queries()["op2_html_suffix"](spark, SF_MORE).toPandas().merge(pages, on="page_id")
    assert len(got) == len(pages) and (got.text == got.html.map(article)).all() and (got.n_chars == got.text.str.len()).all()


def test_html_structure(spark):
    page = """<html><body><header><h1>Site</h1></header><nav>m</nav><main><header><h2>T</h2></header><p>one<p>two <b>bold</b>
    text</p><div class="cookie-notice">c</div><ul><li>i1<li>i2</ul><section id="comments"><p>reader</p></section>
    <form><p>f</p></form><table><tr><td>c1</td><td>c2</td></tr></table></main><p>outside</p><footer>f</footer></body></html>"""
    assert html_suffix.main_texts([html_suffix.page_blocks(page)]) == ["T\n\none\n\ntwo bold text\n\ni1\n\ni2\n\nc1\n\nc2"]
    # without an article the host's suffix array decides
    same = "this line of boilerplate stands on every page of the host here"
    pages = [html_suffix.page_blocks(f"<body><div>{same}</div><div>own words of page {k} {' '.join(f'w{k}x{j}' for j in range(9))}</div></body>") for k in range(4)]
    assert all(same not in t and t.startswith("own words of page") for t in html_suffix.main_texts(pages))


def test_shared_tokens():
    rng = random.Random(4)
    pages = [[rng.randrange(3) for _ in range(rng.randrange(0, 40))] for _ in range(12)]
    got = html_suffix.shared_tokens(pages, 4, 3)
    for page, marks in zip(pages, got, strict=True):
        want = [False] * len(page)
        for s in range(len(page) - 3):
            run = page[s : s + 4]
            if sum(any(other[i : i + 4] == run for i in range(len(other) - 3)) for other in pages) >= 3:
                want[s : s + 4] = [True] * 4
        assert marks.tolist() == want


def test_urls(spark):
    pages = pd.read_parquet(f"{SF_MORE}/pages.parquet")
    rules = sorted(queries.RULES, key=lambda r: -len(r.text))
    got = {r["page_id"]: r for r in queries.queries()["op1_url_templates"](spark, SF_MORE).collect()}
    assert len(got) == len(pages)
    for page, url in zip(pages.page_id, pages.url, strict=True):
        parts = urlsplit(url)
        host, path = parts.netloc.lower(), parts.path
        rule = next((r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), None)
        assert (got[page]["host"], got[page]["path"], got[page]["rule"]) == (host, path, rule and rule.text)
        if rule:
            assert got[page]["verdict"] == rule.verdict


def test_url_templates(spark):
    from gradewell.llm.url_templates import judge_urls

    rows = [(k, f"http://h.org/{'spam' if k % 2 else 'news'}/{k}/page-{k}.html") for k in range(60)]
    rows += [(100 + k, f"http://h.org/wiki/{name}") for k, name in enumerate(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 40)] + [(100 + k, 0) for k in range(20)], "page_id long, blocked int")
    got = {r["page_id"]: r for r in judge_urls(pages, [], labels).collect()}
    assert all(got[k]["verdict"] == ("block" if k % 2 else "allow") for k in range(60))
    # news and wiki are alike in their labels, so they are one branch
    assert got[150]["template"] == "/news|wiki/*" and got[150]["verdict"] == "allow"
    assert got[41]["template"] == "/spam/{n}/page-{n}.html"


def test_pipeline(spark):
    frame, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, SF)
        assert after.columns == frame.columns
        kept.append((name, frame.toPandas(), after.toPandas()))
        frame = after
    stages = {name: (before, after) for name, before, after in kept}
    before, after = stages["near_copies"]
    groups = brute_components(dict(zip(before.doc_id, before.text, strict=True)), corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert sorted(after.doc_id) == sorted(i for i, (_, root) in groups.items() if i == root)
    before, after = stages["decontamination"]
    bench = pd.read_parquet(f"{SF}/benchmark.parquet").text
    assert not any(x in t for x in bench for t in after.text)
    before, after = stages["mixing"]
    counts = Counter(after.doc_id)
    assert set(counts) <= set(before.doc_id) and 0.5 < len(after) / len(before) < 1.6
    rows = corpus_pipeline.token_output(spark, frame, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == counts
