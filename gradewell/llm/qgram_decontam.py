"""Benchmark decontamination: the q-gram lemma in diagonal bands, then banded alignment.

Both sides are normalised: lower case, each run of other characters than letters and digits as
one space. A document leaks an item if a run of PASSAGE of the item's characters (all of a shorter
item), wherever it begins, occurs in the document within its edit budget. By the q-gram lemma such
a run of m characters with at most k edits shares at least (m - q + 1) - k * q of its q-grams with
its region, all of them on diagonals that are at most k apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import store

#: Characters of a q-gram; edits allowed for each character of a passage.
Q, EDITS = 12, 0.05
#: Characters of a passage. Items shorter than LEAST characters must occur without edits.
PASSAGE, LEAST = 120, 40
#: Items are matched in blocks of so many characters, so that what tasks hold stays small.
BLOCK_CHARS = 4_000_000
TABLE_BITS = 22
#: Places of a text that are looked up at a time; a run and its region lie in two neighbouring steps.
PLACES = 1 << 12

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each run of q code points."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    spread = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    run, have, out, done = spread, 1, None, 0
    base, left = 0x100000001B3 | 1, q
    # doubling: a run of 2w is a run of w and the next one, w further on
    while left:
        if left & 1:
            part = run[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, have, 1 << 64)) + part
            done += have
        left >>= 1
        if left:
            run = run[:-have] * np.uint64(pow(base, have, 1 << 64)) + run[have:]
            have *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def budget(length: int) -> int:
    return int(length * EDITS) if length >= LEAST else 0


@dataclass
class Index:
    """Items of a block: their texts, and the q-grams of those that have any, sorted by hash."""

    ids: list[int]
    texts: list[str]
    codes: list[np.ndarray]
    short: list[int]
    grams: np.ndarray
    owners: np.ndarray
    offsets: np.ndarray
    table: np.ndarray
    target: np.ndarray  # characters of a passage of each item
    most: np.ndarray  # edits that it may have


def index_of(items: list[tuple[int, str]]) -> Index:
    ids, texts, grams, owners, offsets = [], [], [], [], []
    for item, text in items:
        plain = normal(text)
        if plain:
            found = gram_hashes(code_points(plain))
            grams.append(found)
            owners.append(np.full(len(found), len(ids), dtype=np.int32))
            offsets.append(np.arange(len(found), dtype=np.int32))
            ids.append(item)
            texts.append(plain)
    every = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
    order = np.argsort(every, kind="stable")
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[(every >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    joined = [np.concatenate(x)[order] if x else np.zeros(0, dtype=np.int32) for x in (owners, offsets)]
    target = np.array([min(PASSAGE, len(t)) for t in texts], dtype=np.int64)
    most = np.array([budget(m) for m in target.tolist()], dtype=np.int64)
    short = [k for k, t in enumerate(texts) if len(t) < Q]
    return Index(ids, texts, [code_points(t) for t in texts], short, every[order], *joined, table, target, most)


def aligned_run(item: np.ndarray, text: np.ndarray, lowest: int, width: int, target: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment, inside a band of diagonals, of a run of ``target``
    characters of ``item`` with a part of ``text``, if it needs at most ``most`` edits; places are
    those in ``text``. A diagonal is a text place less the item's.

    For each number of edits and each diagonal the earliest row that an alignment up to here can have
    begun at is carried from row to row, so all runs are tried at once.
    """
    rows = len(item)
    places = np.arange(rows)[:, None] + lowest + np.arange(width)
    inside = (places >= 0) & (places < len(text))
    same = inside & (text[np.clip(places, 0, len(text) - 1)] == item[:, None])
    far = np.int64(1) << 60
    # a state is the row and, below it, the diagonal that the alignment began at
    begun = np.full((most + 1, width), far, dtype=np.int64)
    fresh = np.arange(width, dtype=np.int64)
    begun[0] = fresh
    best = None
    for i in range(rows):
        new = np.where(same[i], begun, far)
        np.minimum(new[1:], np.where(inside[i], begun[:-1], far), out=new[1:])  # another character
        np.minimum(new[1:, :-1], begun[:-1, 1:], out=new[1:, :-1])  # an item's character is missing
        np.minimum(new[0], (i + 1) * width + fresh, out=new[0])
        for e in range(1, len(new)):
            np.minimum(new[e, 1:], new[e - 1, :-1], out=new[e, 1:])  # a character of the text is extra
        begun = new
        done = np.argwhere(begun // width <= i + 1 - target)
        if len(done):
            edits, d = done[0].tolist()
            start, end = divmod(int(begun[edits, d]), width), i + 1 + lowest + d
            best = (edits, max(0, start[0] + lowest + start[1]), min(end, len(text)))
            if not edits:
                break
            begun = begun[:edits]
    return best


def exact_runs(where: np.ndarray, owner: np.ndarray, offset: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """(owner, place, offset) where enough q-grams lie one after the other on a diagonal for a whole
    passage without edits, earliest places first."""
    order = np.lexsort((where, where - offset, owner))
    w, o, f = where[order], owner[order], offset[order]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (w[1:] != w[:-1] + 1) | (f[1:] != f[:-1] + 1)))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(w)))
    long = length >= index.target[o[first]] - Q + 1
    first = first[long]
    for k in first[np.argsort(w[first], kind="stable")].tolist():
        yield int(o[k]), int(w[k]), int(f[k])


def bands(diagonal: np.ndarray, offset: np.ndarray, most: int, need: int, target: int) -> Iterator[tuple[int, int, int, int]]:
    """(lowest diagonal, fewest edits, first row, last row) of the bands in which some ``target``
    characters of the item share ``need`` different q-grams or more with the text, by diagonal. Bands are
    2 * (most + 1) diagonals wide and overlap by half, so that any most + 1 neighbouring
    diagonals lie in one."""
    width, grams = most + 1, target - Q + 1
    lowest = int(diagonal.min())
    cell = (diagonal - lowest) // width
    order = np.lexsort((offset, cell))
    cell, offset = cell[order], offset[order]
    edges = np.searchsorted(cell, np.arange(int(cell[-1]) + 2)) if cell[-1] < 4 * len(cell) else None
    cells = np.unique(cell)

    def rows(c: int) -> np.ndarray:
        if edges is not None:
            return offset[edges[c] : edges[c + 1]] if 0 <= c < len(edges) - 1 else offset[:0]
        return offset[np.searchsorted(cell, c) : np.searchsorted(cell, c, side="right")]

    done = -2
    for c in cells.tolist():
        for low in (c - 1, c):
            if low <= done:
                continue
            done = low
            held = np.unique(np.concatenate((rows(low), rows(low + 1))))
            if len(held) < need:
                continue
            full = np.searchsorted(held, held + grams) - np.arange(len(held))  # of the run that begins here
            enough = np.flatnonzero(full >= need)
            if len(enough):
                fewest = max(0, -(-(grams - int(full.max())) // Q))
                yield lowest + low * width, fewest, int(held[enough[0]]) - grams, int(held[enough[-1]]) + grams + target


def leaks(text: str | None, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) for each item with a passage in the text, at its best passage: the
    one of fewest edits, of equal ones the first by place (without edits) or by diagonal. Places are
    in the normalised text."""
    plain = normal(text)
    best: dict[int, tuple[int, int, int]] = {}  # owner: edits, start, end
    hashes = gram_hashes(code_points(plain))
    at = np.flatnonzero(index.table[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]) if len(hashes) else np.zeros(0, dtype=np.int64)
    low = np.searchsorted(index.grams, hashes[at], side="left")
    counts = np.searchsorted(index.grams, hashes[at], side="right") - low
    at, low, counts = at[counts > 0], low[counts > 0], counts[counts > 0]
    if len(at):
        codes, seen = code_points(plain), {}
        # texts are taken in overlapping steps, so that one with very many pairs is bounded
        for step in np.unique(at // PLACES).tolist():
            start, end = np.searchsorted(at, [step * PLACES, (step + 1) * PLACES + 2 * PASSAGE])
            n = counts[start:end]
            where = np.repeat(at[start:end], n)
            entry = np.repeat(low[start:end] - np.cumsum(n) + n, n) + np.arange(n.sum())
            owner, offset = index.owners[entry], index.offsets[entry].astype(np.int64)
            _step(plain, codes, where, owner, offset, index, best, seen)
    for owner in index.short:
        place = f" {plain} ".find(f" {index.texts[owner]} ")
        if place >= 0:
            best[owner] = (0, place, place + len(index.texts[owner]))
    out: dict[int, tuple[int, int, int]] = {}
    for owner, found in best.items():
        item = index.ids[owner]
        out[item] = min(found, out.get(item, found))
    return sorted((item, start, end, edits) for item, (edits, start, end) in out.items())


def _step(plain: str, codes: np.ndarray, where: np.ndarray, owner: np.ndarray, offset: np.ndarray, index: Index, best: dict, seen: dict) -> None:
    """Takes the finds among the pairs of a step into ``best``. ``seen`` holds what regions that were
    aligned before gave: periodic texts show the same ones again and again."""
    size = np.bincount(owner, minlength=len(index.ids))
    grams = index.target - Q + 1
    need = np.maximum(1, grams - Q * index.most)
    hot = size >= need
    for k, (edits, _, _) in best.items():
        hot[k] &= edits > 0
    keep = hot[owner]
    if not keep.any():
        return
    where, owner, offset = where[keep], owner[keep], offset[keep]
    for k, place, row in exact_runs(where, owner, offset, index):
        target = int(index.target[k])
        if best.get(k, (1,))[0] and plain[place : place + target] == index.texts[k][row : row + target]:
            best[k] = (0, place, place + target)
    order = np.argsort(owner, kind="stable")
    where, owner, offset = where[order], owner[order], offset[order]
    firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    for start, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(owner)], strict=True):
        k = int(owner[start])
        most, target, item = int(index.most[k]), int(index.target[k]), index.codes[k]
        most = min(most, best[k][0] - 1) if k in best else most
        if most < 1:
            continue  # found without edits, or only so to be found
        for lowest, fewest, first, last in bands(where[start:end] - offset[start:end], offset[start:end], int(index.most[k]), int(need[k]), target):
            if fewest > most:
                continue
            first, last, width = max(0, first), min(len(item), last), 2 * (int(index.most[k]) + 1)
            begin = max(0, first + lowest)
            region = codes[begin : last + lowest + width]
            key = (k, first, last, most, first + lowest - begin, region.tobytes())
            if key not in seen:
                seen[key] = aligned_run(item[first:last], region, first + lowest - begin, width, target, most)
            if seen[key]:
                edits, a, b = seen[key]
                best[k] = (edits, begin + a, begin + b)
                most = edits - 1
                if most < 1:
                    break


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it leaks: id_col, item_col, start, end, edits
    (the item's best passage; places in the normalised text). Other documents have no row.

    A document leaks an item if any run of PASSAGE of its characters (all of a shorter item) occurs
    in it with at most EDITS edits for each character; whole texts are compared.
    Items go to the tasks in blocks of BLOCK_CHARS characters, one block after the other: the
    documents are read once for each, its finds are stored, and neither driver nor tasks hold
    more than one block.

    Null and empty items or documents have no leaks; items without letters or digits have none.
    Repeated items with one id count as one. Repeated documents have their rows each. Rows with a
    null id are compared too. Empty tables give an empty result.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for index in _indexes(docs, benchmark, item_col, item_text_col):
        part = store(plain.mapInPandas(_matcher(index), "doc_id long, item long, start int, end int, edits int"), "leaks")
        index.destroy()
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("doc_id").alias(id_col), F.col("item").alias(item_col), "start", "end", "edits")


def _indexes(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str) -> Iterator:
    """A broadcast index of each block of items, one after the other."""
    items = benchmark.filter(F.length(text_col) > 0)
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    for number in range(blocks):
        held = [(r["item"], r["text"]) for r in items.filter(block == number).collect()]  # about BLOCK_CHARS characters
        yield docs.sparkSession.sparkContext.broadcast(index_of(held))


def _matcher(spread):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = spread.value
        for frame in frames:
            rows = [(doc, *leak) for doc, text in zip(frame["doc_id"], frame["text"], strict=True) for leak in leaks(text, index)]
            made = pd.DataFrame(rows, columns=["doc_id", "item", "start", "end", "edits"])
            yield made.astype({"doc_id": "Int64"})

    return run


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, with all their columns.

    As ``find_leaks``, but each row is judged where it is: nothing is joined by id, so rows with a
    null or a repeated id are rows like all others. With more than one block of items, what each
    block leaves is stored for the next.
    """
    clean = None
    for index in _indexes(docs, benchmark, item_col, item_text_col):
        left = docs if clean is None else store(clean, "clean")
        clean = left.filter(_is_clean(index)(F.col(text_col)))
    return clean


def _is_clean(spread):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not leaks(text, spread.value) for text in texts], dtype=bool)

    return clean
