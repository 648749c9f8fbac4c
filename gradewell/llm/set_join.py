"""Exact Jaccard self-join of documents' word shingles, skipping by set relations.

Similar sets lie in the same index lists and have nearly the same answers. So the lists hold
blocks of similar sets rather than sets, blocks are skipped by size and position, and inside a
block a set's overlaps follow from those of a similar set (the pivot) by the few shingles in
which they differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.common import components, store
from gradewell.llm.shingles import batches, shingle_sets
from gradewell.operators.skew import own_shuffle

#: Words in a shingle, and the least similarity in per cent.
SHINGLE, PERCENT = 4, 85
#: Sets in a block, about, and shingles in it, about: the fewer of both. Entries of one piece of an
#: index list, about.
BLOCK_SETS, BLOCK_TOKENS, PIECE = 256, 1 << 20, 4096
#: The frequency sketch has 2**bits counters, one for each row about, so many at least and at most (64 MB).
SKETCH_BITS = (18, 24)
#: Needed sets are broadcast to the scan of the texts up to so many (about 32 MB), and joined beyond.
BROADCAST_SETS = 1_000_000


def prefix_length(n: int, percent: int) -> int:
    """Two sets that reach the similarity share a shingle among so many of the rarest of a set of n."""
    return n - -(-percent * n // 100) + 1


def _sets(frame: pd.DataFrame, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for start, texts in batches(frame["text"]):
        yield from enumerate(shingle_sets(texts, size), start)


def _fingerprint(found: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype=np.int64)
    return int(both[0]), int(both[1])


def facts(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """What one reading of the texts tells: rows (doc_id, n, f1, f2) with the size and the 128-bit
    fingerprint of each document's set, and rows (cell, held) from each task with the number of its
    sets that hold a shingle of each of 2**bits groups of shingles."""
    shift = np.uint64(64 - bits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, waiting = np.zeros(1 << bits, dtype=np.int64), []
        for frame in frames:
            rows = []
            for _, found in _sets(frame, size):
                rows.append((len(found), *_fingerprint(found)))
                waiting.append(found)
                if len(waiting) >= 2000:
                    counts += np.bincount((np.concatenate(waiting) >> shift).astype(np.int64), minlength=1 << bits)
                    waiting = []
            made = pd.DataFrame(rows, columns=["n", "f1", "f2"])
            made.insert(0, "doc_id", frame["doc_id"].astype("Int64").array)
            yield made.assign(cell=pd.NA, held=pd.NA).astype({"cell": "Int64", "held": "Int64"})
        if waiting:
            counts += np.bincount((np.concatenate(waiting) >> shift).astype(np.int64), minlength=1 << bits)
        some = np.flatnonzero(counts)
        none = pd.array([None] * len(some), dtype="Int64")
        yield pd.DataFrame({"doc_id": none, "n": none, "f1": none, "f2": none, "cell": some, "held": counts[some]})

    return docs.mapInPandas(run, "doc_id long, n long, f1 long, f2 long, cell long, held long")


def sketch(found: DataFrame, bits: int) -> np.ndarray:
    """The counts of ``facts`` summed: for each shingle, an upper bound of its frequency. The
    sketch's size does not grow with its input, and it reaches the driver packed."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells, sums = frame["cell"].to_numpy(dtype="<u4"), np.minimum(frame["held"], 2**32 - 1).to_numpy(dtype="<u4")
            yield pd.DataFrame({"cells": [cells.tobytes()], "sums": [sums.tobytes()]})

    sums = found.filter("cell is not null").groupBy("cell").agg(F.sum("held").alias("held"))
    out = np.zeros(1 << bits, dtype=np.uint32)
    for row in sums.mapInPandas(pack, "cells binary, sums binary").toLocalIterator():
        out[np.frombuffer(row["cells"], dtype="<u4")] = np.frombuffer(row["sums"], dtype="<u4")
    return out


def postings(docs: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(token, piece, pieces, f1, n, i): each set's rarest shingles with their positions i.

    The order of shingles is by the sketch's count, then by hash. The list of a shingle that the
    sketch holds to be frequent is dealt over several pieces by fingerprint. Equal sets within a
    task give one entry."""
    spread = docs.sparkSession.sparkContext.broadcast(counts)
    shift = np.uint64(64 - (len(counts).bit_length() - 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[int] = set()
        counts = spread.value
        for frame in frames:
            parts: list[tuple] = []
            for _, found in _sets(frame, size):
                f1, _ = _fingerprint(found)
                if f1 in known or not len(found):
                    continue
                if len(known) < 1 << 20:
                    known.add(f1)
                often = counts[(found >> shift).astype(np.int64)]
                first = np.argsort(often, kind="stable")[: prefix_length(len(found), percent)]
                pieces = (often[first] // PIECE + 1).astype(np.int64)
                parts.append((found[first].view(np.int64), f1 % pieces, pieces, np.full(len(first), f1), np.full(len(first), len(found)), np.arange(len(first))))
                if len(parts) >= 1000:
                    yield _frame(parts)
                    parts = []
            if parts:
                yield _frame(parts)

    return docs.mapInPandas(run, "token long, piece int, pieces int, f1 long, n int, i int")


def _frame(parts: list[tuple]) -> pd.DataFrame:
    names = ["token", "piece", "pieces", "f1", "n", "i"]
    return pd.DataFrame({name: np.concatenate(column) for name, column in zip(names, zip(*parts, strict=True), strict=True)})


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the sorted ``a`` has and the sorted ``b`` has not; neither is empty."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return a[b[at] != a]


def linked(arrays: list[np.ndarray], groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (x, y) that join sets into components, by index; sets of equal ``groups`` count as
    joined from the start, and no more links are sought than joining needs.

    The first set is the pivot. |x & y| = |p| - |p-x| - |p-y| + |(p-x) & (p-y)| + |(x-p) & (y-p)|:
    only the differences from the pivot are looked up, through an inverted index of them."""
    m = len(arrays)
    sizes = np.fromiter(map(len, arrays), dtype=np.int64, count=m)
    pivot = arrays[0]
    gone = [_minus(pivot, a) for a in arrays]
    new = [_minus(a, pivot) for a in arrays]
    lacks = np.fromiter(map(len, gone), dtype=np.int64, count=m)
    tokens = np.concatenate([np.concatenate((g, a)) for g, a in zip(gone, new, strict=True)])
    ends = np.cumsum(np.fromiter((len(g) + len(a) for g, a in zip(gone, new, strict=True)), dtype=np.int64, count=m))
    owner = np.repeat(np.arange(m), np.diff(ends, prepend=0))
    _, code = np.unique(tokens, return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders = owner[order]
    length = np.bincount(code)
    begin = np.cumsum(length) - length

    _, group = np.unique(groups, return_inverse=True)
    left, links = len(np.unique(group)), []
    for x in range(m):
        if left == 1:
            break
        other = group != group[x]
        fits = other & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
        if not fits.any():
            continue
        own = code[ends[x] - len(gone[x]) - len(new[x]) : ends[x]]
        spans = length[own]
        at = np.repeat(begin[own] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        shared = len(pivot) - lacks - lacks[x] + np.bincount(holders[at], minlength=m)
        for y in np.flatnonzero(fits & (100 * shared >= percent * (sizes + sizes[x] - shared))):
            if group[y] != group[x]:
                links.append((x, int(y)))
                group[group == group[y]] = group[x]
                left -= 1
    return links


def _linker(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["first", "set_id"], ascending=[False, True])
        ids = frame["set_id"].to_numpy()
        arrays = [np.frombuffer(x, dtype=np.uint64) for x in frame["tokens"]]
        links = linked(arrays, frame["comp"].to_numpy(), percent)
        return pd.DataFrame([(ids[x], ids[y]) for x, y in links], columns=["a", "b"], dtype="int64")

    return run


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id.

    A document's set is its distinct shingles of ``size`` words (A-Z lower-cased; fewer words are
    one shingle). Documents link when 100 * intersection >= percent * union; component_id is the
    smallest id that links lead to. No link between different sets is lost: every pair of sets
    that can link shares a shingle among the rarest of both (``prefix_length``), so their blocks
    meet in that shingle's list, and blocks that meet are compared set by set.

    1. Equal sets become one (by 128-bit fingerprints).
    2. Index lists: shingle -> sets that have it among their rarest; lists of one set go.
    3. A set's leader is the smallest set that it meets in most of its lists; sets with the same
       leader form blocks of about BLOCK_SETS sets. Leaders only shape the blocks.
    4. Each list is reduced to blocks with ranges of size and position. Pairs of blocks whose
       ranges, or whose number of shared lists, rule out the needed overlap are skipped.
    5. Links inside blocks (with the leader), then between blocks that meet: the smaller block's
       sets visit the larger one, in rooms of about as many visitors as a block has sets. A pair of blocks is
       skipped where all its sets are in one component already.

    Shingles are compared as 64-bit hashes. Null and empty texts, and texts of white space, have
    an empty set, n_shingles 0 and their own id as component_id. Equal rows link with each other.
    Ids are integers that name one text each; a row whose id is null is returned with a null
    component_id unless it equals another row. An empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], docs.count().bit_length()))
    found = store(facts(docs, size, bits), "facts")
    members = found.filter("cell is null").select("doc_id", "n", "f1", "f2")
    groups = members.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("set_id")).filter("set_id is not null")
    groups = store(groups, "groups")

    lists = postings(docs, size, percent, sketch(found, bits))
    piece = Window.partitionBy("token", "piece")
    lists = lists.withColumns({"low": F.min("f1").over(piece), "high": F.max("f1").over(piece)})
    lists = lists.filter("low != high or pieces > 1").select("token", "f1", "n", "i").distinct()
    lists = lists.join(groups.select("f1", "n", "set_id"), ["f1", "n"]).select("token", "set_id", "n", "i")
    lists = store(lists, "lists")

    leads = lists.groupBy("token").agg(F.min("set_id").alias("lead"))
    votes = lists.join(own_shuffle(leads, "token"), "token").groupBy("set_id", "lead", "n").count()
    most = votes.filter(F.col("count") * 4 * 100 >= F.col("n") * (100 - percent)).groupBy("set_id")
    chosen = most.agg(F.max_by("lead", F.struct("count", -F.col("lead"))).alias("lead"))
    heard = lists.select("set_id", "n").distinct().join(chosen, "set_id", "left")
    heard = heard.select("set_id", "n", F.coalesce("lead", "set_id").alias("lead"))
    parts = heard.groupBy("lead").agg(_portions().alias("parts"))
    split = F.pmod(F.xxhash64("set_id"), F.col("parts"))
    blocks = heard.join(own_shuffle(parts, "lead"), "lead")
    blocks = store(blocks.select("set_id", "lead", "n", F.xxhash64("lead", split).alias("block")), "blocks")

    entries = lists.join(blocks.select("set_id", "block"), "set_id").groupBy("token", "block")
    entries = entries.agg(*(f(c).alias(f"{c}_{f.__name__}") for c in ("n", "i") for f in (F.min, F.max)))
    entries = store(entries, "entries")
    a, b = entries.alias("a"), entries.alias("b")
    able = (
        f"a.block < b.block and 100 * a.n_max >= {percent} * b.n_min and 100 * b.n_max >= {percent} * a.n_min and "
        f"{100 + percent} * (1 + least(a.i_max, b.i_max) + least(a.n_max - a.i_min, b.n_max - b.i_min) - 1) "
        f">= {percent} * (a.n_min + b.n_min)"
    )
    pairs = a.join(b, F.expr("a.token = b.token and " + able)).groupBy(F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    ranges = [f(f"{side}.n_{f.__name__}").alias(f"{side}_{f.__name__}") for side in "ab" for f in (F.min, F.max)]
    pairs = pairs.agg(F.count("*").alias("shared"), *ranges)
    # shared shingles beyond one set's rarest are at most the rest of that set
    rest = f"greatest(ceil({percent} * a_max / 100), ceil({percent} * b_max / 100)) - 1"
    pairs = pairs.filter(f"{100 + percent} * (shared + {rest}) >= {percent} * (a_min + b_min)").select("x", "y")
    pairs = store(pairs, "pairs")

    met = pairs.select(F.col("x").alias("block")).union(pairs.select(F.col("y").alias("block"))).distinct()
    several = blocks.groupBy("block").count().filter("count > 1").select("block")
    several = several.withColumn("several", F.lit(True))
    needed = blocks.join(met.union(several.select("block")).distinct(), "block", "left_semi").join(several, "block", "left")
    needed = store(needed.select("set_id", "block", "lead", "n", F.coalesce("several", F.lit(False)).alias("several")), "needed")
    # a cluster's leader is a guest in the cluster's other blocks
    homes = needed.filter("several").select("block", F.col("lead").alias("set_id")).distinct()
    guests = homes.join(needed.select("block", "set_id"), ["block", "set_id"], "left_anti")
    guests = guests.select("set_id", "block", F.col("set_id").alias("lead"), F.lit(True).alias("several"), F.lit(True).alias("guest"))
    asked = needed.drop("n").withColumn("guest", F.lit(False)).union(guests)  # twice as many as are needed, at most
    asked = F.broadcast(asked) if needed.count() <= BROADCAST_SETS else asked
    texts = docs.join(asked, docs["doc_id"] == asked["set_id"]).select("set_id", "block", "lead", "several", "guest", "text")
    arrays = store(_arrays(texts, size), "arrays")

    first = (F.col("set_id") == F.col("lead")).alias("first")
    inside = arrays.filter("several").select("block", "set_id", first, F.col("set_id").alias("comp"), "tokens")
    links = store(inside.groupBy("block").applyInPandas(_linker(percent), "a long, b long"), "links")

    state = components(links)
    placed = needed.join(state, F.col("set_id") == F.col("node"), "left")
    placed = store(placed.select("set_id", "block", "n", F.coalesce("root", "set_id").alias("comp")), "placed")
    spans = placed.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
    for side in "xy":
        pairs = pairs.join(spans.select(F.col("block").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in spans.columns[1:])), side)
    pairs = pairs.filter("least(x_low, y_low) != greatest(x_high, y_high)")
    # the smaller block's sets visit the larger block, together with all others that do
    swap = F.expr("x_size < y_size")
    visits = pairs.select(
        *(F.when(swap, F.col(f"y{c}")).otherwise(F.col(f"x{c}")).alias(f"to{c}") for c in ("", "_low", "_high")),
        F.when(swap, F.col("x")).otherwise(F.col("y")).alias("block"),
    )
    visits = visits.join(placed, "block").filter("to_low != comp or to_high != comp").select("to", "set_id", "comp", "n").distinct()
    visits = store(visits, "visits")
    rooms = visits.groupBy("to").agg(_portions().cast("int").alias("rooms"))
    room = F.pmod(F.xxhash64("set_id"), F.col("rooms")).cast("int")
    guests = visits.join(own_shuffle(rooms, "to"), "to").select("to", room.alias("room"), "set_id", "comp")
    hosts = rooms.join(placed.withColumnRenamed("block", "to"), "to")
    hosts = hosts.select("to", F.explode(F.expr("sequence(0, rooms - 1)")).alias("room"), "set_id", "comp")
    across = guests.union(hosts).join(arrays.filter("not guest").select("set_id", "tokens"), "set_id").withColumn("first", F.lit(False))
    across = across.select("to", "room", "set_id", "first", "comp", "tokens")
    more = store(across.groupBy("to", "room").applyInPandas(_linker(percent), "a long, b long"), "links")

    final = components(links.union(more))
    sets = groups.join(final, F.col("set_id") == F.col("node"), "left")
    sets = sets.select("f1", "f2", "n", F.coalesce("root", "set_id").alias("component_id"))
    full = members.filter("n > 0").join(own_shuffle(sets, "f1"), ["f1", "f2", "n"], "left")
    return (
        full.select("doc_id", "n", "component_id")
        .union(members.filter("n = 0").select("doc_id", "n", "doc_id"))
        .select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    )


def _portions() -> Column:
    """Into how many portions sets go so that each has about BLOCK_SETS of them and BLOCK_TOKENS
    of their shingles at most."""
    return F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS))


def _arrays(texts: DataFrame, size: int) -> DataFrame:
    names = ["set_id", "block", "lead", "several", "guest", "tokens"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, held = [*frame[names[:-1]].itertuples(index=False)], []
            for k, found in _sets(frame, size):
                held.append((*keys[k], found.tobytes()))
                if len(held) >= 500:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            yield pd.DataFrame(held, columns=names)

    return texts.mapInPandas(run, "set_id long, block long, lead long, several boolean, guest boolean, tokens binary")
