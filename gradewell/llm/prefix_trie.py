"""The trie of conversations by their turns, with what sharing prefixes would save.

A turn is the 128-bit digest of its role and text, so texts are never shuffled and a conversation
is one row of 20 bytes a turn. Rows are dealt and sorted by their turns; a node is then a run of
rows. Tasks take blocks of rows as padded matrices of turn ids and work out all nodes of a block
at once. Nodes at the edges of a block may go on in the next ones: they come out as partial
records, which are put together by the digest of their prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import small_batches, store

DIGEST = 16
#: Cells of a block's padded matrix (about 60 MB in all); a longer conversation is a block of its own.
CELLS = 1 << 20
#: Rows of a block at most, whatever their length.
BLOCK_ROWS = 1 << 16
#: Ids of a piece of a partial node's list of ends.
PIECE = 1 << 15
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


# Turns --------------------------------------------------------------------------
def _digest(role: str, text: str) -> Column:
    """Hex digest of a turn; the role's length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(" "), role, text))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of ``conversations`` (conv_id, turn, role, text): the turns in order, each
    (digest, words). Null turns come first, equal ones in the order of their digests; null roles and
    texts count as empty. Repeated rows are turns of their own. Rows without a conv_id belong to no
    conversation and are left out."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    turn = F.struct(F.col("turn").isNotNull().alias("there"), "turn", _digest("role", "text").alias("digest"), words.alias("words"))
    lists = conversations.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t.digest.alias("digest"), t.words.alias("words"))).alias("turns"))


def with_heads(lists: DataFrame, head_of: Column, length: Column, most: int) -> DataFrame:
    """``lists`` with the first ``length`` turns (``most`` at most) of each taken from those of the
    conversation ``head_of``: all that it has if fewer, none if there is no such conversation."""
    heads = lists.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    own = lists.select("conv_id", "turns", head_of.alias("_base"), length.alias("_h"))
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


# Nodes of a block ---------------------------------------------------------------
def _matrix(paths: list[bytes], words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded matrices of a block: turn ids (numbers in the order of the digests, -1 past the end),
    words, and the rows' lengths."""
    lengths = np.array([len(p) // DIGEST for p in paths])
    deep = int(lengths.max(initial=0))
    ids, counts = np.full((len(paths), deep), -1, dtype=np.int64), np.zeros((len(paths), deep), dtype=np.int64)
    inside = np.arange(deep) < lengths[:, None]
    if deep:
        turns = np.frombuffer(b"".join(paths), dtype=np.dtype([("high", ">u8"), ("low", ">u8")]))
        order = np.lexsort((turns["low"], turns["high"]))
        ordered = turns[order]
        new = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        number = np.empty(len(turns), dtype=np.int64)
        number[order] = np.cumsum(new)
        ids[inside], counts[inside] = number, np.concatenate(words)
    return ids, counts, lengths


def block_nodes(conv: np.ndarray, paths: list[bytes], words: list[np.ndarray], block: int) -> tuple[dict, list[tuple]]:
    """All nodes of a block of rows, by column, and (key, block, piece, ids): the lists of ends of
    its partial nodes.

    A node is a run of rows with one prefix. It is partial if it holds the first or the last row.
    Of a partial node the block counts what it sees, as if no rows were before and after it.
    """
    ids, counts, lengths = _matrix(paths, words)
    order = np.lexsort((conv, *ids.T[::-1]))
    ids, counts, lengths, conv = ids[order], counts[order], lengths[order], conv[order]
    rows, deep = ids.shape
    # changed[i, j]: the first j turns of row i are not those of the row before
    changed = np.zeros((rows, deep + 2), dtype=bool)
    changed[0] = True
    changed[1:, 1 : deep + 1] = np.logical_or.accumulate(ids[1:] != ids[:-1], axis=1)
    changed[:, deep + 1] = changed[:, deep]
    above = np.zeros((rows, deep + 1), dtype=np.int64)  # words of the first j turns
    np.cumsum(counts, axis=1, out=above[:, 1:])
    total = above[:, deep]
    shared = np.minimum((~changed[:, 1 : deep + 1]).sum(axis=1), lengths)
    shared[1:] = np.minimum(shared[1:], lengths[:-1])
    leaf = np.append(shared[1:] < lengths[:-1], True).astype(np.int64)
    fresh = total - above[np.arange(rows), shared]  # words of the nodes that a row opens
    fresh[0] = total[0]
    keys = {row: _prefix_digests(paths[order[row]]) for row in (0, rows - 1)}

    found: dict[str, list] = {name: [] for name in _COLUMNS if name not in ("block", "piece", "ids")}
    pieces: list[tuple] = []
    before, before_least, before_partial = np.zeros(1, dtype=np.int64), None, None
    for depth in range(deep + 1):
        starts = np.flatnonzero(changed[:, depth])
        ends = np.append(starts[1:], rows)
        words_above = above[:, max(depth - 1, 0)]
        opened = fresh.copy()
        opened[starts] = total[starts] - words_above[starts]
        least = np.minimum.reduceat(conv, starts)
        finished = np.add.reduceat(lengths == depth, starts, dtype=np.int64)
        partial = (starts == 0) | (ends == rows)
        held = np.flatnonzero(lengths[starts] >= depth)
        key_of = [keys[0 if s == 0 else rows - 1][depth] if p else None for s, p in zip(starts[held], partial[held], strict=True)]
        digests = []
        for k, key in zip(held, key_of, strict=True):
            members = conv[starts[k] : starts[k] + finished[k]]
            if key is not None:
                pieces += [(key, block, at, ",".join(map(str, members[at : at + PIECE].tolist()))) for at in range(0, len(members), PIECE)]
            text = b"" if key is not None else ",".join(map(str, members.tolist())).encode()
            digests.append(hashlib.sha256(text).hexdigest() if text else NO_ENDS)
        if depth:
            up = np.searchsorted(before, starts[held], side="right") - 1
            parent_of = [None if before_partial[u] else int(before_least[u]) for u in up]
            parent_key = [keys[0 if before[u] == 0 else rows - 1][depth - 1] if before_partial[u] else None for u in up]
        else:
            parent_of, parent_key = [None], [None]
        columns = {
            "depth": np.full(len(held), depth, dtype=np.int32),
            "conv_id": least[held],
            "parent_conv_id": parent_of,
            "n_convs": (ends - starts)[held],
            "n_children": np.add.reduceat(changed[:, depth + 1] & (lengths > depth), starts, dtype=np.int64)[held],
            "n_leaves": np.add.reduceat(leaf, starts)[held],
            "saved_tokens": np.add.reduceat(total - words_above - opened, starts)[held],
            "ends_sha256": digests,
            "key": key_of,
            "parent_key": parent_key,
            "first": (starts == 0)[held],
            "last": (ends == rows)[held],
            "above": words_above[starts[held]],
            "own": above[starts[held], depth] - words_above[starts[held]],
            "row_end": np.full(len(held), lengths[-1]),
        }
        for name, values in columns.items():
            found[name].append(values)
        before, before_least, before_partial = starts, least, partial
    return found, pieces


def _prefix_digests(path: bytes) -> list[bytes]:
    """Digests of the prefixes of a row's turns, from none to all."""
    state, out = hashlib.blake2b(digest_size=DIGEST), []
    out.append(state.digest())
    for at in range(0, len(path), DIGEST):
        state.update(path[at : at + DIGEST])
        out.append(state.digest())
    return out


_NODES = (
    "block long, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, key binary, parent_key binary, first boolean, last boolean, above long, own long, row_end long, piece long, ids string"
)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in _NODES.split(", "))])
_COLUMNS = _SCHEMA.names


def _as_batches(nodes: dict, pieces: list[tuple], block: int) -> Iterator[pa.RecordBatch]:
    kinds = {name: _SCHEMA.field(name).type for name in _COLUMNS}
    columns = {name: pa.concat_arrays([pa.array(v, kinds[name]) for v in parts]) for name, parts in nodes.items()}
    size = len(columns["depth"])
    columns["block"] = pa.array(np.full(size, block))
    yield from pa.Table.from_arrays([columns.get(n, pa.nulls(size, kinds[n])) for n in _COLUMNS], schema=_SCHEMA).to_batches(10_000)
    for piece in pieces:
        row = dict(zip(("key", "block", "piece", "ids"), piece, strict=True))
        yield pa.RecordBatch.from_pydict({name: [row.get(name)] for name in _COLUMNS}, schema=_SCHEMA)


def _blocks(cells: int, block_rows: int):
    """Sorted rows (conv_id, path, words) to the nodes of their blocks, and the pieces of ends as
    rows of their own (``ids`` is not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        conv, paths, words, deep = [], [], [], 1
        for batch in batches:
            counts = batch.column("words")
            flat, offsets = counts.values.to_numpy(zero_copy_only=False), counts.offsets.to_pylist()
            for k, (c, path) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                own = max(1, len(path) // DIGEST)
                if conv and ((len(conv) + 1) * max(deep, own) > cells or len(conv) >= block_rows):
                    yield from _as_batches(*block_nodes(np.array(conv, dtype=np.int64), paths, words, block), block)
                    block, conv, paths, words, deep = block + 1, [], [], [], 1
                deep = max(deep, own)
                conv.append(c)
                paths.append(path)
                words.append(flat[offsets[k] : offsets[k + 1]])
        if conv:
            yield from _as_batches(*block_nodes(np.array(conv, dtype=np.int64), paths, words, block), block)

    return run


# Whole nodes from partial ones --------------------------------------------------
def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's pieces, which come in order; holds one piece at a time."""
    key, state = None, None
    for frame in frames:
        for own, ids in zip(frame["key"], frame["ids"], strict=True):
            if own != key:
                if key is not None:
                    yield pd.DataFrame({"key": [key], "ends_sha256": [state.hexdigest()]})
                key, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if key is not None:
        yield pd.DataFrame({"key": [key], "ends_sha256": [state.hexdigest()]})


def _corrected(partial: DataFrame) -> DataFrame:
    """Partial records as they are once the rows before and after their block count.

    A node of a block's first row that an earlier block holds too was not opened here, and if the
    last row of a block is a prefix of what follows, it closes no leaf there.
    """
    spans = partial.groupBy("key").agg(F.min("block").alias("from_block"), F.max("block").alias("to_block"))
    known = partial.join(spans, "key")
    went_on = F.col("first") & (F.col("from_block") < F.col("block"))
    closes = F.col("last") & (F.col("depth") == F.col("row_end")) & (F.col("to_block") > F.col("block"))
    edges = known.groupBy("block").agg(
        F.max(F.when(went_on, F.col("depth"))).alias("_open"),
        F.max(F.when(went_on, F.col("above") + F.col("own"))).alias("_open_words"),
        F.max(closes).alias("_goes_on"),
    )
    was_open = F.col("first") & (F.col("depth") <= F.col("_open"))
    child_open = F.col("first") & (F.col("depth") < F.col("_open"))
    return (
        known.join(edges, "block")
        .withColumn("n_children", F.col("n_children") - F.coalesce(child_open, F.lit(False)).cast("long"))
        .withColumn("n_leaves", F.col("n_leaves") - (F.col("last") & F.col("_goes_on")).cast("long"))
        .withColumn("saved_tokens", F.col("saved_tokens") + F.when(was_open, F.col("_open_words") - F.col("above")).otherwise(0))
    )


def prefix_trie(lists: DataFrame, cells: int = CELLS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each node of the trie of ``lists`` (conv_id, turns of (digest, words)), as
    ``turn_lists`` gives them; conv_id must be unique.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256):
    a node is named by its depth and its smallest member. ``n_leaves`` and ``saved_tokens`` are
    those of its subtree; ``ends_sha256`` is of the decimal ids of the members that end in it. A
    conversation without turns is a member of the root only. No conversations: no nodes.

    Rows are dealt by range of (turns, conv_id), so copies of one conversation and conversations
    with one beginning spread over tasks like any others; a block of ``cells`` matrix cells is all
    that a task holds. Each block gives two partial records a depth at most. A conversation itself
    is a row and must fit a task.
    """
    spark = lists.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), ""))
    flat = store(lists.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t.words).alias("words")), "turn-ids")
    dealt = flat.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    seen = store(dealt.mapInArrow(_blocks(cells, block_rows), _NODES), "trie")
    nodes = seen.filter("ids IS NULL")
    partial = store(_corrected(nodes.filter("key IS NOT NULL")), "trie-edges")

    pieces = seen.filter("ids IS NOT NULL").select("key", "block", "piece", "ids")
    in_order = pieces.repartition("key").sortWithinPartitions("key", "block", "piece")
    with small_batches(spark, 64):
        ends = store(in_order.mapInPandas(_hashed, "key binary, ends_sha256 string"), "trie-ends")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    joined = partial.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), *sums)
    joined = store(joined.join(ends, "key", "left"), "trie-joined")
    names = joined.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    at_edges = joined.join(names, "parent_key", "left").withColumn("parent_conv_id", F.col("_parent"))
    at_edges = at_edges.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    whole = nodes.filter("key IS NULL")
    below = whole.filter("parent_key IS NOT NULL").drop("parent_conv_id")
    # children of a node at an edge are many; they meet its name by block, where they are few
    here = partial.select("block", F.col("key").alias("parent_key")).join(names, "parent_key")
    below = below.join(here, ["block", "parent_key"]).withColumnRenamed("_parent", "parent_conv_id")
    return whole.filter("parent_key IS NULL").select(columns).unionByName(below.select(columns)).unionByName(at_edges.select(columns))
