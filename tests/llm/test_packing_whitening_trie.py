"""Packing, whitening and the conversation trie against plain versions, and on odd tables."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradewell.llm import encoder, packing, prefix_trie, queries, whitening
from gradewell.llm.queries import TOKENIZER
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path(TOKENIZER)
CLASHES = ["ids", "part", "before", "begin", "base", "key", "block", "path", "words", "vector", "n", "depth", "row", "p"]


def with_clashes(df):
    return df.withColumns({name: F.lit(f"own {name}") for name in CLASHES})


# Encoder ------------------------------------------------------------------------
ODD = [
    "", "  ", "İstanbul ΣΑΣ ς", "don't I'll'd 's", "<|endoftext|> <|EndOfText|> <| x", "é é É ÀÉ ß ẞ ﬁ", "a1b22 ²½ Ⅷ",
    "x y z\x85w\x1cq", "...a,b. c, d.", "naïve,co-op.", "日本 語。テスト", "🙂🙂 a🙂", "\x00 a\x00b", "ªº µ ŉ ǰ ȿ", "ſt K Å",
    "ñandú!! $$$é, ÿ.", "x" * 3000, "word " * 3000,
]


def test_encoder_equals_the_tokenizer():
    plain = Tokenizer.from_file(PATH)
    texts = ODD + pd.read_parquet(f"{SF_SMALL}/documents.parquet").text.fillna("").tolist()
    for n in (1, 1000):
        encode = encoder.Encoder(PATH, 2)
        got = [ids for at in range(0, len(texts), n) for ids in encode([t.encode() for t in texts[at : at + n]])]
        want = [e.ids + [2] for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert [[*struct.unpack(f"<{len(x) // 4}I", x)] for x in got] == want


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(encoder, "REMEMBERED", 3)
    encode, plain = encoder.Encoder(PATH, None), Tokenizer.from_file(PATH)
    for k in range(40):
        text = f"one two three four {k % 7} word{'abc'[k % 3]} five"
        assert encode([text.encode()]) == [struct.pack(f"<{len(w)}I", *w) for w in [plain.encode(text).ids]]


def test_encoder_takes_other_files_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    assert encoder.Encoder(path, None).pattern is None
    for text, ids in zip(ODD, encoder.Encoder(path, None)([t.encode() for t in ODD]), strict=True):
        want = plain.encode(text, add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(want)}I", *want)


# Packing ------------------------------------------------------------------------
def check_pieces(docs, pieces, window, end_id=1):
    """``pieces`` against the plain encoding of ``docs`` (id, text), ids being unique."""
    plain, own = Tokenizer.from_file(PATH), defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append(p)
    for doc, text in docs:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [end_id]
        parts = sorted(own.pop(doc), key=lambda p: p["start"])
        assert [p["start"] for p in parts] == [*accumulate((q["length"] for q in parts[:-1]), initial=0)]
        assert b"".join(bytes(p["ids"]) for p in parts) == struct.pack(f"<{len(ids)}I", *ids)
        assert {p["doc_tokens"] for p in parts} == {len(ids)} == {sum(p["length"] for p in parts)}
        assert [p["opens"] for p in parts] == [True] + [False] * (len(parts) - 1)
        assert [p["closes"] for p in parts] == [False] * (len(parts) - 1) + [True]
    assert not own
    held = defaultdict(list)
    for p in pieces:
        assert p["length"] > 0 and len(p["ids"]) == 4 * p["length"]
        held[p["sequence_id"]].append((p["offset"], p["length"]))
    sizes = []
    for number in sorted(held):
        at = 0
        for offset, length in sorted(held[number]):
            assert offset == at
            at += length
        sizes.append(at)
    assert [*sorted(held)] == [*range(len(held))]
    assert all(n == window or n.bit_count() == 1 for n in sizes) and max(sizes, default=0) <= window


@pytest.mark.parametrize("window", [1, 7, 64, 2048])
def test_packing(spark, window):
    rng = random.Random(window)
    docs = [(k, " ".join(rng.choice(["alpha", "beta,", "gam9ma", "é"]) for _ in range(rng.choice((0, 1, 5, 300))))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "long " * 9000)]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    pieces = packing.pack(df, PATH, window=window)
    check_pieces(docs, pieces.collect(), window)
    total = sum(r["length"] for r in pieces.select("length").collect())
    for row in packing.sequences(pieces).collect():
        assert len(row["ids"]) == 4 * row["n_tokens"] <= 4 * window and row["bounds"] == sorted(row["bounds"])
        total -= row["n_tokens"]
    assert total == 0


def test_packing_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), PATH).collect() == []
    same = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "d"), (None, None)], schema)
    rows = packing.pack(same, PATH).collect()
    assert sorted((r["doc_id"] or -1, r["doc_tokens"]) for r in rows if r["opens"]) == [(-1, 1), (-1, 2), (5, 4), (5, 4)]
    assert sum(r["length"] for r in rows) == 11
    without = packing.pack(same, PATH, end_id=None).collect()
    assert sum(r["length"] for r in without) == 7 and {r["doc_id"] for r in without} == {5, None}


def test_packing_query(spark):
    docs = pd.read_parquet(f"{SF_SMALL}/documents.parquet")
    got = queries.op11_packing(spark, SF_SMALL).collect()
    plain = Tokenizer.from_file(PATH)
    ids = {d: plain.encode(t or "", add_special_tokens=False).ids + [1] for d, t in zip(docs.doc_id, docs.text, strict=True)}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own)) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    assert max(r["sequence_id"] for r in got) < sum(map(len, ids.values())) // 2048 + 12


# Whitening ----------------------------------------------------------------------
def plain_whitening(vectors, components):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    deviation = [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))) for row in x]
    return n, deviation, centred @ v / np.sqrt(e), e / (centred**2).sum() * n


def check_whitening(rows, ids, vectors, components=8, tolerance=1e-7):
    n, deviation, want, share = plain_whitening(vectors, components)
    at = {i: k for k, i in enumerate(ids)}
    got = np.zeros_like(want)
    assert len(rows) == len(ids) * want.shape[1]
    for r in rows:
        k, j = at[r["vec_id"]], r["component"] - 1
        got[k, j] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[k]
        assert r["explained"] == pytest.approx(share[j], rel=1e-9) and r["identity_error"] < 1e-9
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < tolerance


def test_whitening_query(spark):
    table = pd.read_parquet(f"{SF_SMALL}/embeddings.parquet")
    check_whitening(queries.op12_whitening(spark, SF_SMALL).collect(), table.vec_id.tolist(), table.embedding.tolist())


def test_whitening_leaves_out_what_is_not_finite(spark):
    rng = np.random.default_rng(3)
    good = [(k, (rng.standard_normal(5) * [9, 5, 3, 2, 1]).tolist()) for k in range(60)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [1.0, float("inf"), 0.0, 0.0, 0.0]), (104, [float("-inf")] * 5)]
    df = with_clashes(spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").repartition(4))
    check_whitening(whitening.whiten(df).collect(), [k for k, _ in good], [v for _, v in good])
    check_whitening(whitening.whiten(df, components=2).collect(), [k for k, _ in good], [v for _, v in good], 2)


def test_whitening_of_odd_tables(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    assert run([]) == [] and run([(1, None), (2, [])]) == []
    same = run([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])
    assert len(same) == 6 and all(r["whitened"] == r["explained"] == r["identity_error"] == r["deviation"] == 0 for r in same)
    line = run([(k, [float(k), float(2 * k), 7.0]) for k in range(10)])  # one component only
    first = [r for r in line if r["component"] == 1]
    assert sum(r["whitened"] ** 2 for r in first) == pytest.approx(10) and first[0]["explained"] == pytest.approx(1)
    assert all(r["whitened"] == r["explained"] == 0 for r in line if r["component"] > 1)
    far = run([(k, [1e12 * k, 3.0]) for k in range(4)])  # deviations beyond 64 bits
    x = [int(1024 * 1e12 * k) for k in range(4)]
    assert {r["vec_id"]: int(r["deviation"]) for r in far} == {k: (4 * x[k] - sum(x)) ** 2 for k in range(4)}
    with pytest.raises(Exception, match="one length"):
        run([(1, [1.0]), (2, [1.0, 2.0])])


@pytest.mark.parametrize("n", [1, 2, 3, 8, 65])
def test_divide(n):
    rng = np.random.default_rng(n)
    for spectrum in (rng.random(n) * 1e4, np.ones(n), np.zeros(n), np.repeat([3.0, 1.0], [n // 2, n - n // 2]), 3.0 ** -np.arange(n)):
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        a = q @ np.diag(spectrum) @ q.T
        for wanted in (1, 8, None):
            values, vectors = whitening.divide((a + a.T) / 2, wanted)
            k, scale = len(values), max(np.abs(a).max(), 1e-300)
            assert k == min(wanted or n, n) and np.allclose(values, np.sort(spectrum)[::-1][:k], rtol=0, atol=1e-12 * scale)
            assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
            assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * scale


# Trie ---------------------------------------------------------------------------
def plain_trie(paths):
    """Rows of the trie of {conv_id: tuple of (turn, words)}."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, path in paths.items():
        ends[path].append(conv)
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    below = defaultdict(set)
    for node in members:
        if node:
            below[node[:-1]].add(node)
    rows = []
    for node in members:
        subtree, todo = [], [node]
        while todo:
            subtree.append(todo.pop())
            todo += below[subtree[-1]]
        rows.append(
            (
                min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below[node]),
                sum(not below[x] for x in subtree), sum((len(members[x]) - 1) * x[-1][1] for x in subtree if x),
                hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
            )
        )
    return sorted(rows, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def as_paths(lists):
    return {r["conv_id"]: tuple((t["digest"], t["words"]) for t in r["turns"]) for r in lists.collect()}


@pytest.mark.parametrize("cells, block_rows", [(1, 9), (6, 9), (40, 9), (1 << 20, 1 << 16)])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed, cells, block_rows):
    rng, rows = random.Random(seed), []
    for conv in range(150):
        kind = rng.random()
        turns = ["same"] * 3 if kind < 0.3 else ["same"] * rng.randrange(6) if kind < 0.5 else [rng.choice("ab ") * rng.randrange(4) + " x" for _ in range(rng.randrange(1, 7))]
        rows += [(conv - 5, None if k == 0 and kind > 0.9 else k, rng.choice(["u", "v", None]) if kind > 0.8 else "u", text) for k, text in enumerate(turns)]
    rows += [(900, k, "u", "deep") for k in range(70)] + [(None, 1, "u", "nowhere"), (901, None, None, None)]
    rng.shuffle(rows)
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    lists = prefix_trie.turn_lists(df)
    got = trie_rows(prefix_trie.prefix_trie(lists.repartition(3), cells, block_rows))
    assert got == plain_trie(as_paths(lists))


def test_trie_pieces_of_ends(spark, monkeypatch):
    lists = spark.range(500).selectExpr("id AS conv_id", "array(named_struct('digest', md5('a'), 'words', 2)) AS turns")
    short = lists.limit(3).selectExpr("conv_id + 1000 AS conv_id", "slice(turns, 1, 0) AS turns")
    both = lists.unionByName(short)
    assert trie_rows(prefix_trie.prefix_trie(both, block_rows=37)) == plain_trie(as_paths(both))


def test_trie_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = prefix_trie.turn_lists(spark.createDataFrame([], schema))
    assert prefix_trie.prefix_trie(empty).collect() == []
    one = prefix_trie.turn_lists(spark.createDataFrame([(7, 2, "u", "b c"), (7, None, "u", "a"), (7, 2, "u", "b c")], schema))
    rows = trie_rows(prefix_trie.prefix_trie(one))
    assert [r[:7] for r in rows] == [(7, 0, None, 1, 1, 1, 0), (7, 1, 7, 1, 1, 1, 0), (7, 2, 7, 1, 1, 1, 0), (7, 3, 7, 1, 0, 1, 0)]


def rebuilt(table):
    """The contract's conversations of a table, by plain code: turns are (role, text)."""
    own = {}
    for conv, part in table.groupby("conv_id"):
        part = part.assign(nr=part.turn.astype("float").fillna(float("-inf"))).sort_values("nr", kind="stable")
        own[int(conv)] = [(r or "", t or "") for r, t in zip(part.role, part.text, strict=True)]
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = own.get(conv - conv % 20, [])[:h] + turns[h:]
    return out


def words(text):
    for space in "\t\n\v\f\r":
        text = text.replace(space, " ")
    return len([w for w in text.split(" ") if w])


def test_trie_query(spark):
    table = pd.read_parquet("/root/testdata/sf0.01/conversations.parquet")
    paths = {c: tuple(((role, text), words(text)) for role, text in turns) for c, turns in rebuilt(table).items()}
    assert trie_rows(queries.op13_prefix_trie(spark, "/root/testdata/sf0.01")) == plain_trie(paths)
