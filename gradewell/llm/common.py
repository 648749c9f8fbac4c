"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.operators.skew import own_shuffle
from gradewell.sources.shared import shared_folder

@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Python workers get at most ``rows`` rows at once in what runs meanwhile: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and a
    lost executor costs no recomputation of what came before."""
    path = shared_folder(df.sparkSession, purpose)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_share(doc_id: str, shares: int) -> Column:
    """The crc32 of an id as text, modulo ``shares``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % shares


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that is
    reachable, and is itself a row.

    Alternating large-star and small-star rounds: each round hangs the neighbours of a node
    on the smallest of them. Edges stay distributed and are written to the shared folder
    after each round; a node with very many edges is combined map-side, and its side of the
    join can be split. Raises if it hasn't settled after ``rounds``.
    """

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(df.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(own_shuffle(low, "u"), "u")
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                low.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        return out.filter(F.col("a") != F.col("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = store(edges.filter(F.col("a") != F.col("b")).distinct(), "edges")
    before = state(edges)
    for _ in range(rounds):
        edges = store(star(star(edges, True), False), "edges")
        now = state(edges)
        if now == before:
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError(f"components have not settled after {rounds} rounds")
