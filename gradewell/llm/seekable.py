"""Token ids in binary files of independent zstandard frames with a seek table.

A file: the frames of its documents, one after the other, then the seek table as a zstandard
skippable frame, so that any zstandard reader can decompress the file as a whole.

    frame            one document's ids, little-endian unsigned 32-bit, as a zstandard frame
    skippable frame  magic 0x184D2A5E and length (2 x u32), then the entries and the footer
    entry            i64 document id, u64 offset, u32 bytes, u32 tokens, u32 crc32 of the ids,
                     u32 crc32 of the frame's bytes
    footer           u64 number of entries, u32 crc32 of the entries, 8 bytes "TOKSEEK1"
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import small_batches
from gradewell.llm.encoder import text_batches, worker_encoder
from gradewell.sources.shared import shared_folder

SKIPPABLE, NAME = 0x184D2A5E, b"TOKSEEK1"
ENTRY = np.dtype([("id", "<i8"), ("at", "<u8"), ("bytes", "<u4"), ("tokens", "<u4"), ("ids_crc", "<u4"), ("frame_crc", "<u4")])
FOOTER = "<QI8s"
FOOTER_BYTES = struct.calcsize(FOOTER)
#: A file holds about so many input characters; one read task takes about so many frames.
FILE_CHARS, READ_FRAMES = 32_000_000, 4096


def encoded(docs: DataFrame, bounds: list[int], tokenizer_path: str, end_id: int | None) -> DataFrame:
    """(doc_id, n_tokens, ids_crc, frame, bucket): each text's ids as a zstandard frame; the bucket
    is the number of ``bounds`` (ascending) that are below the id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, pack = worker_encoder(tokenizer_path, end_id), zstandard.ZstdCompressor(level=1)
        edges = np.array(bounds, dtype=np.int64)
        for frame in frames:
            ids = frame["doc_id"].to_numpy()
            buckets = np.searchsorted(edges, ids, side="left")
            for start, texts in text_batches(frame["text"]):
                raw = encode(texts)
                yield pd.DataFrame(
                    {
                        "doc_id": ids[start : start + len(raw)],
                        "n_tokens": [len(x) // 4 for x in raw],
                        "ids_crc": [zlib.crc32(x) for x in raw],
                        "frame": [pack.compress(x) for x in raw],
                        "bucket": buckets[start : start + len(raw)],
                    }
                )

    return docs.mapInPandas(run, "doc_id long, n_tokens long, ids_crc long, frame binary, bucket int")


def _opened(folder: str):
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def _write(folder: str):
    """Writes each bucket's frames to a file of its own; a file appears under its name only when
    it is whole, so a task that runs again replaces it with the same bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        out, bucket, held, at, tokens, draft = None, None, [], 0, 0, ""

        def finish() -> pd.DataFrame:
            entries = np.concatenate(held).tobytes()
            footer = struct.pack(FOOTER, len(entries) // ENTRY.itemsize, zlib.crc32(entries), NAME)
            out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
            out.close()
            name = f"tokens-{bucket:07d}.bin"
            files.move(draft, f"{root}/{name}")
            return pd.DataFrame({"bucket": [bucket], "file": [name], "n_docs": [len(entries) // ENTRY.itemsize], "n_tokens": [tokens]})

        for frame in frames:
            for own, part in frame.groupby("bucket", sort=True):
                if out is not None and own != bucket:
                    yield finish()
                    out = None
                if out is None:
                    bucket, held, at, tokens = int(own), [], 0, 0
                    draft = f"{root}/draft-{bucket}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(draft)
                sizes = part["frame"].map(len).to_numpy()
                rows = np.zeros(len(part), dtype=ENTRY)
                rows["id"], rows["bytes"], rows["tokens"], rows["ids_crc"] = part["doc_id"], sizes, part["n_tokens"], part["ids_crc"]
                rows["at"] = at + np.cumsum(sizes) - sizes
                rows["frame_crc"] = [zlib.crc32(x) for x in part["frame"]]
                out.write(b"".join(part["frame"]))
                held.append(rows)
                at, tokens = at + int(sizes.sum()), tokens + int(part["n_tokens"].sum())
        if out is not None:
            yield finish()

    return run


def seek_table(file) -> np.ndarray:
    """The entries of an open file's seek table, read from its end; raises if it is damaged."""
    end = file.seek(0, os.SEEK_END) or file.tell()
    file.seek(end - FOOTER_BYTES)
    count, crc, name = struct.unpack(FOOTER, file.read(FOOTER_BYTES))
    if name != NAME:
        raise ValueError("not a token file")
    file.seek(end - FOOTER_BYTES - count * ENTRY.itemsize)
    raw = file.read(count * ENTRY.itemsize)
    if zlib.crc32(raw) != crc:
        raise ValueError("the seek table is damaged")
    return np.frombuffer(raw, dtype=ENTRY)


def frame_ids(file, entry) -> bytes:
    """The ids of one document, as little-endian u32; reads only its frame and checks both checksums."""
    file.seek(int(entry["at"]))
    packed = file.read(int(entry["bytes"]))
    if zlib.crc32(packed) != entry["frame_crc"]:
        raise ValueError(f"the frame of document {entry['id']} is damaged")
    raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=4 * int(entry["tokens"]) or 1)
    if len(raw) != 4 * entry["tokens"] or zlib.crc32(raw) != entry["ids_crc"]:
        raise ValueError(f"the ids of document {entry['id']} are damaged")
    return raw


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes ``docs`` as token files under ``folder`` and returns their list:
    bucket, file, n_docs, n_tokens, start (tokens in all files before it), first (documents).

    Files hold ranges of ids that do not overlap, each in ascending order, so all documents are
    in ascending order of id over the files in order. The ranges come from the id column's
    quantiles; texts are read, encoded and shuffled (as compressed frames) once. Rows with equal
    ids stay separate, next to each other; many of one id make a larger file.
    Null and empty texts have no ids but the end id; rows with a null id come first and have id -1
    in the file. An empty table writes nothing.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc_id"), F.col(text_col).alias("text"))
    facts = plain.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows")).first()
    files = max(1, -(-(facts["chars"] or 0) // FILE_CHARS), min(spark.sparkContext.defaultParallelism, facts["rows"]))
    shares = [k / files for k in range(1, files)]
    bounds = plain.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 100_000)).first()[0] if shares else []
    bounds = sorted({*(bounds or [])})
    frames = encoded(plain, bounds, tokenizer_path, end_id).repartitionById(len(bounds) + 1, "bucket")
    frames = frames.sortWithinPartitions("bucket", "doc_id", "ids_crc")
    listed = frames.mapInPandas(_write(folder), "bucket int, file string, n_docs long, n_tokens long")
    path = f"{folder.rstrip('/')}/list.parquet"
    with small_batches(spark):
        listed.write.parquet(path)
    rows = sorted(spark.read.parquet(path).collect())  # one row for each file
    made, start, first = [], 0, 0
    for row in rows:
        made.append((*row, start, first))
        start, first = start + row["n_tokens"], first + row["n_docs"]
    return spark.createDataFrame(made, "bucket int, file string, n_docs long, n_tokens long, start long, first long")


def read_tokens(listed: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files of ``listed``; ids is binary,
    start counts the ids of all documents before it. Tasks take runs of frames of a file and read
    only those; damaged frames or tables raise."""
    every = F.explode(F.expr(f"sequence(0L, n_docs - 1, {READ_FRAMES}L)")).alias("from")
    runs = listed.select("file", "start", every)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _opened(folder)
        for frame in frames:
            for name, start, at in frame.itertuples(index=False):
                with files.open_input_file(f"{root}/{name}") as file:
                    entries = seek_table(file)
                    starts = start + np.cumsum(entries["tokens"].astype(np.int64)) - entries["tokens"]
                    chosen, held, size = range(at, min(at + READ_FRAMES, len(entries))), [], 0
                    for k in chosen:
                        raw = frame_ids(file, entries[k])
                        held.append((int(entries[k]["id"]), int(starts[k]), len(raw) // 4, raw))
                        size += len(raw)
                        if size > 8 << 20 or k == chosen[-1]:
                            yield pd.DataFrame(held, columns=["doc_id", "start", "n_tokens", "ids"])
                            held, size = [], 0

    spread = max(1, listed.sparkSession.sparkContext.defaultParallelism)
    return runs.repartition(spread, "file", "from").mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes ``docs`` as token files (``write_tokens``) and reads every document back
    (``read_tokens``). The files stay in ``folder``, a new one in the shared folder by default."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer_path, end_id, id_col, text_col), folder)
