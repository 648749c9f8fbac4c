"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: for every context of up to ORDER bytes that is
frequent enough, the counts of the bytes that follow it. A byte costs its code length under the
longest kept context, with escapes to shorter ones (method C: a context that was seen n times
with d different bytes escapes with probability d / (n + d); bytes that the longer context has
seen are excluded from the shorter). The language whose tree codes a text shortest is predicted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest context in bytes, and how often a context must occur in training to be kept.
ORDER, LEAST = 3, 12
#: Training texts of each language, about, taken by a hash of the id. This bounds the model: it holds
#: contexts that occur LEAST times in one language's texts.
TEXTS_PER_LANGUAGE = 1500
SEED = 5
CHUNK = 1 << 20


def counts_of(texts: list[bytes]) -> pd.DataFrame:
    """(key, order, n): how often each byte follows each context of 0..ORDER bytes; key holds the
    context and then the byte. Contexts do not reach across texts."""
    parts = []
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
    at = np.concatenate([np.arange(len(t)) for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    for order in range(ORDER + 1):
        key = data.copy()
        for back in range(1, order + 1):
            key[back:] |= data[:-back] << (8 * back)
        found, n = np.unique(key[at >= order], return_counts=True)
        parts.append(pd.DataFrame({"key": found, "order": order, "n": n}))
    return pd.concat(parts)


@dataclass
class Trees:
    """Frozen statistics of all languages as code lengths in bits.

    A context has a cell for each byte that follows it in some language. Any other byte costs the
    context's escape and then what it costs in the next shorter kept context."""

    languages: list[str]
    cell: np.ndarray  # [context * 256 + byte]: number of the cell, -1 where there is none
    bits: np.ndarray  # [cell, language]
    escape: np.ndarray  # [context, language]
    shorter: np.ndarray  # [context]: the next shorter kept context
    nodes: list[tuple[np.ndarray, np.ndarray]]  # per order: kept contexts, ascending, and their rows

    def row_bits(self, row: int) -> np.ndarray:
        """Code lengths of all bytes after a context, [byte, language]."""
        cells = self.cell[row * 256 : row * 256 + 256]
        if row == 0:
            return self.bits[cells]
        return np.where((cells >= 0)[:, None], self.bits[cells], self.escape[row] + self.row_bits(self.shorter[row]))


def grow(counts: pd.DataFrame) -> Trees:
    """The trees for (lang, order, key, n) rows.

    A context is kept for all languages alike if one of them has it LEAST times. In a language
    that lacks it, the code length is that of the shorter context."""
    languages = sorted(counts["lang"].unique())
    number = {name: k for k, name in enumerate(languages)}
    counts = counts.assign(context=counts["key"] // 256, byte=counts["key"] % 256, l=counts["lang"].map(number))
    totals = counts.groupby(["order", "context", "l"])["n"].sum().groupby(["order", "context"]).max()
    kept = totals[totals >= LEAST]
    names = [(0, 0), *sorted(kept[kept.index.get_level_values("order") > 0].index)]
    rows = {name: k for k, name in enumerate(names)}
    counts = counts.assign(row=[rows.get(x, -1) for x in zip(counts["order"], counts["context"], strict=True)])
    counts = counts[counts["row"] >= 0].sort_values("row", kind="stable")
    first = np.searchsorted(counts["row"].to_numpy(), np.arange(len(names) + 1))
    byte, lang, n = (counts[c].to_numpy() for c in ("byte", "l", "n"))

    shape = (256, len(languages))
    trees = Trees(languages, np.full(256 * len(names), -1, dtype=np.int32), np.zeros((0, shape[1]), dtype=np.float32),
                  np.zeros((len(names), shape[1]), dtype=np.float32), np.zeros(len(names), dtype=np.int32), [])
    held, count = [], 0
    for k, (order, context) in enumerate(names):
        own = np.zeros(shape)
        part = slice(first[k], first[k + 1])
        own[byte[part], lang[part]] = n[part]
        if order == 0:
            below = np.full(shape, 1 / 256)
        else:
            trees.shorter[k] = next(rows[o, context % 256**o] for o in range(order - 1, -1, -1) if (o, context % 256**o) in rows)
            below = np.exp2(-_row_bits(trees, held, int(trees.shorter[k])))
        total, kinds = own.sum(axis=0), (own > 0).sum(axis=0)
        rest = np.where(own > 0, 0.0, below)
        left = rest.sum(axis=0)
        scale = np.where(left > 0, total + kinds, np.maximum(total, 1))
        share = np.where((left > 0) & (total > 0), kinds / np.maximum(scale, 1) / np.where(left > 0, left, 1), 1.0)
        p = np.where(own > 0, own / np.maximum(scale, 1), share * below)
        trees.escape[k] = -np.log2(np.maximum(share, 1e-30))
        there = np.arange(256) if order == 0 else np.flatnonzero(own.any(axis=1))
        trees.cell[k * 256 + there] = count + np.arange(len(there))
        held.append(-np.log2(np.maximum(p[there], 1e-30)).astype(np.float32))
        count += len(there)
    trees.bits = np.concatenate(held)
    for order in range(1, ORDER + 1):
        own = sorted((context, rows[o, context]) for o, context in names if o == order)
        trees.nodes.append((np.array([c for c, _ in own], dtype=np.int64), np.array([r for _, r in own], dtype=np.int32)))
    return trees


def _row_bits(trees: Trees, held: list[np.ndarray], row: int) -> np.ndarray:
    """``row_bits`` while the trees grow: ``held`` has the cells of each context so far."""
    if row == 0:
        return held[0].astype(np.float64)
    out = trees.escape[row] + _row_bits(trees, held, int(trees.shorter[row]))
    out[trees.cell[row * 256 : row * 256 + 256] >= 0] = held[row]
    return out


class Coder:
    """Code lengths of texts under all trees. Context rows are looked up in dense tables."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.tables = []
        for order, (contexts, rows) in enumerate(trees.nodes, 1):
            table = np.zeros(256**order, dtype=np.uint16 if len(trees.shorter) < 65536 else np.int32)
            table[contexts] = rows
            self.tables.append(table)

    def rows(self, data: np.ndarray) -> np.ndarray:
        """The row of the longest kept context before each byte."""
        out = np.zeros(len(data), dtype=np.int64)
        context = np.zeros(len(data), dtype=np.int32)
        for order, table in enumerate(self.tables, 1):
            if len(data) <= order:
                break
            context[order:] |= data[:-order].astype(np.int32) << (8 * (order - 1))
            found = table[context[order:]]
            np.copyto(out[order:], found, where=found > 0)
        return out

    def lengths(self, text: bytes) -> np.ndarray:
        """The code length of the whole text in bits, for each language."""
        trees = self.trees
        total = np.zeros(len(trees.languages))
        for start in range(0, len(text), CHUNK):
            before = min(start, ORDER)
            data = np.frombuffer(text[start - before : start + CHUNK], dtype=np.uint8)
            row, byte = self.rows(data)[before:], data[before:]
            cell = trees.cell[row * 256 + byte]
            while True:
                total += trees.bits[cell[cell >= 0]].sum(axis=0, dtype=np.float64)
                none = cell < 0
                row, byte = row[none], byte[none]
                if not len(row):
                    break
                total += trees.escape[row].sum(axis=0, dtype=np.float64)
                row = trees.shorter[row].astype(np.int64)
                cell = trees.cell[row * 256 + byte]
        return total


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column | None) -> Trees | None:
    """The trees of the documents for which ``learn`` holds and the language is known: about
    TEXTS_PER_LANGUAGE whole texts of each. Tasks count; counts are summed by Spark, and their
    number is bounded by the sample."""
    known = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    known = known if learn is None else known.filter(learn)
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, TEXTS_PER_LANGUAGE / v))))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "id"), 11).cast("double") / float(1 << 53)
    sample = known.filter(draw < F.element_at(share, F.col("lang")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                yield counts_of([x.encode("utf-8", "replace") for x in part["text"]]).assign(lang=lang)

    counts = sample.select("lang", "text").mapInPandas(run, "key long, order int, n long, lang string")
    counts = counts.groupBy("lang", "order", "key").agg(F.sum("n").alias("n")).toPandas()
    return grow(counts) if len(counts) else None


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None
) -> DataFrame:
    """One row per document: id_col, lang_pred, score (0 to 1).

    The trees learn from the documents for which ``learn`` holds (all by default); the text alone
    decides a prediction. score is the share of the best language when each language weighs
    2 ** -(its code length in bits per byte * 8, above the best). Texts that are null or without
    a letter get ``und`` and score 0. Ties go to the language that sorts first. Where no language
    was learned all rows get ``und``. Rows with a null id are predicted like others; an empty
    table gives an empty table.
    """
    trees = train(docs, id_col, text_col, lang_col, learn)
    spread = docs.sparkSession.sparkContext.broadcast(trees)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = spread.value
        coder = Coder(trees) if trees is not None else None
        for frame in frames:
            names, scores = [], []
            for text in frame["text"]:
                if coder is None or not text or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                raw = text.encode("utf-8", "replace")
                rates = coder.lengths(raw) / len(raw)
                best = int(np.argmin(rates))
                names.append(trees.languages[best])
                scores.append(float(1 / np.exp2(-8 * (rates - rates[best])).sum()))
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "lang_pred": names, "score": scores})

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInPandas(run, "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def code_length(text: bytes, trees: Trees, language: str) -> float:
    """The code length of one text byte by byte, for checks."""
    number, total = trees.languages.index(language), 0.0
    rows = [dict(zip(c.tolist(), r.tolist(), strict=True)) for c, r in trees.nodes]
    for i, byte in enumerate(text):
        row = 0
        for order in range(min(ORDER, i), 0, -1):
            found = rows[order - 1].get(int.from_bytes(text[i - order : i], "big"))
            if found is not None:
                row = found
                break
        total += float(trees.row_bits(row)[byte, number])
    return total if not math.isnan(total) else math.inf
