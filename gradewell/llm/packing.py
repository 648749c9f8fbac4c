"""Documents packed into sequences of equal length by concatenating and cutting.

Tasks encode their documents and number the tokens from 0 (first pass, stored); prefix sums over
the tasks' totals, one number a task, give every document its place in the one long run of tokens
(second pass); the run is cut into fixed windows. A piece is a document's part of a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import store
from gradewell.llm.encoder import text_batches, worker_encoder

WINDOW = 2048


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """(part, before, doc_id, doc_tokens, ids) of ``docs`` (doc_id, text): the ids of each text, and
    the task's tokens before it. ``part`` numbers the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, before = worker_encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        for frame in frames:
            for start, texts in text_batches(frame["text"]):
                raw = encode(texts)
                tokens = np.array([len(x) // 4 for x in raw], dtype=np.int64)
                ends = before + np.cumsum(tokens)
                yield pd.DataFrame(
                    {
                        "part": part,
                        "before": ends - tokens,
                        "doc_id": frame["doc_id"].iloc[start : start + len(raw)].to_numpy(),
                        "doc_tokens": tokens,
                        "ids": raw,
                    }
                )
                before = int(ends[-1])

    return docs.mapInPandas(run, "part int, before long, doc_id long, doc_tokens long, ids binary")


def tail_windows(total: int, window: int) -> list[tuple[int, int, int]]:
    """(sequence, from, to) of the tokens that don't fill a window: cut at the powers of two, the
    largest first, so that none of these sequences needs padding where a power of two needs none."""
    sequence, at = divmod(total, window)[0], total - total % window
    out = []
    while at < total:
        size = 1 << ((total - at).bit_length() - 1)
        out.append((sequence, at, at + size))
        sequence, at = sequence + 1, at + size
    return out


def _windows(begin: Column, end: Column, total: int, window: int) -> Column:
    """The windows that tokens ``begin`` to ``end`` of the long run fall into, as an array."""
    full = total - total % window
    shape = "array<struct<sequence_id:bigint,lo:bigint,hi:bigint>>"

    def at(number: Column) -> Column:
        return F.struct(number.alias("sequence_id"), (number * window).alias("lo"), ((number + 1) * window).alias("hi"))

    last = (F.least(end, F.lit(full)) - 1) / window
    fixed = F.when(begin < full, F.transform(F.sequence(F.floor(begin / window), F.floor(last)), at)).otherwise(F.array().cast(shape))
    rest = [F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(row, ("sequence_id", "lo", "hi"), strict=True))) for row in tail_windows(total, window)]
    if not rest:
        return fixed
    return F.concat(fixed, F.filter(F.array(*rest), lambda w: (w.lo < end) & (w.hi > begin)))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all ``docs`` into sequences of ``window`` tokens: (doc_id, start, length, ids,
    doc_tokens, sequence_id, offset, opens, closes), one row for each piece.

    ``start`` counts the document's tokens before the piece, ``offset`` the sequence's; ``ids`` are
    little-endian unsigned 32-bit; ``opens`` and ``closes`` tell whether the document begins and ends
    in it, so a row without both is a record of a boundary that cuts a document. Every token lies
    in exactly one piece and every sequence but those after the last full one is full; these hold a
    power of two of tokens each.

    A null or empty text has only the end id; without an end id it has no piece. Rows are packed
    one by one, whatever their id: rows with equal ids or a null id stay apart. An empty table has
    no pieces. Other columns of ``docs`` are left out.

    Texts are encoded once. Nothing is shuffled: the driver gets one number from every task.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored = store(encoded(plain, tokenizer_path, end_id), "packed")
    sums = stored.groupBy("part").agg(F.sum("doc_tokens").alias("n")).sort("part").collect()  # a row for each task
    totals = [row["n"] for row in sums]
    starts = zip((row["part"] for row in sums), accumulate(totals, initial=0), strict=False)
    bases = spark.createDataFrame([*starts], "part int, base long")
    begin = F.col("base") + F.col("before")
    end = begin + F.col("doc_tokens")

    def piece(w: Column) -> Column:
        lo, hi = F.greatest(w.lo, F.col("begin")), F.least(w.hi, F.col("end"))
        start, length = lo - F.col("begin"), hi - lo
        ids = F.substring("ids", (4 * start + 1).cast("int"), (4 * length).cast("int"))
        parts = {"start": start, "length": length, "ids": ids, "sequence_id": w.sequence_id, "offset": lo - w.lo}
        return F.struct(*(c.alias(n) for n, c in parts.items()))

    return (
        stored.filter("doc_tokens > 0")
        .join(F.broadcast(bases), "part")
        .select("doc_id", "doc_tokens", "ids", begin.alias("begin"), end.alias("end"))
        .select("doc_id", "doc_tokens", F.explode(F.transform(_windows(F.col("begin"), F.col("end"), sum(totals), window), piece)).alias("p"))
        .select(
            "doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset",
            (F.col("p.start") == 0).alias("opens"),
            (F.col("p.start") + F.col("p.length") == F.col("doc_tokens")).alias("closes"),
        )
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, bounds) of the pieces that ``pack`` gives: the ids of each
    sequence, and where in it each piece begins. A group holds one window of tokens at most."""
    row = F.struct("offset", F.hex("ids").alias("hex"), "length")
    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("held"))
    return held.select(
        "sequence_id",
        F.aggregate("held", F.lit(0).cast("long"), lambda n, x: n + x.length).alias("n_tokens"),
        F.unhex(F.array_join(F.transform("held", lambda x: x.hex), "")).alias("ids"),
        F.transform("held", lambda x: x.offset).alias("bounds"),
    )
