"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import store
from gradewell.operators.skew import own_shuffle

SEED = 7


def poisson_steps(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... of a Poisson distribution, up to where a 53-bit draw can
    still tell the difference. A rate of zero gives [1.0]."""
    top = int(rate + 12 * math.sqrt(rate) + 40) if rate > 0 else 0
    k = np.arange(top + 1)
    logs = k * math.log(rate) - rate - np.array([math.lgamma(x + 1) for x in k]) if rate > 0 else np.zeros(1)
    return np.minimum(np.cumsum(np.exp(logs)), 1.0).tolist()


def _with_steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(steps=[poisson_steps(r) for r in frame["rate"]])


def draw(id_col: str, text_col: str, seed: int) -> Column:
    """A uniform value in [0, 1) that depends on seed, id and text only."""
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def source_rates(
    docs: DataFrame,
    weights: DataFrame | None = None,
    source_col: str = "source",
    text_col: str = "text",
    power: float = 0.5,
    epochs: float = 1.0,
) -> DataFrame:
    """(source, n_docs, size, weight, rate): the mean number of copies of each source's documents.

    size is the source's characters. The mix is to hold ``epochs`` times all characters, shared
    out by ``weights`` (source, weight), or by size ** power where none are given. A source with
    no characters, no weight, or a weight that is null, negative or zero gets rate 0.
    """
    size = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"), F.sum(size).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        given = weights.groupBy("source").agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        sizes = sizes.alias("s").join(given.alias("w"), F.expr("s.source <=> w.source"), "left").select("s.*", F.coalesce("w.weight", F.lit(0.0)).alias("weight"))
    used = F.when(F.col("size") > 0, F.col("weight")).otherwise(0.0)
    total = sizes.agg(F.sum(used).alias("all_weight"), F.sum("size").alias("all_size")).first()
    all_weight, all_size = float(total["all_weight"] or 0), float(total["all_size"] or 0)
    rate = F.when((F.col("size") > 0) & F.lit(all_weight > 0), epochs * all_size * F.col("weight") / (all_weight or 1.0) / F.col("size"))
    return sizes.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def poisson_counts(
    docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED
) -> DataFrame:
    """``docs`` with the column _copies: the Poisson count of the source's rate at the row's draw.

    A source's steps are a few dozen numbers, however many documents it has. They are stored, so
    Spark knows their size: it broadcasts few sources, and else may split hot ones in the join."""
    schema = "source string, rate double, steps array<double>"
    steps = rates.select(F.col("source").cast("string"), "rate").mapInPandas(_with_steps, schema)
    key = "_source_key"
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    steps = own_shuffle(store(steps.select(named.alias(key), F.col("steps").alias("_steps")), "rates"), key)
    keyed = docs.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")))
    count = F.size(F.filter("_steps", lambda s: s <= draw(id_col, text_col, seed)))
    return keyed.join(steps, key).withColumn("_copies", count).drop(key, "_steps")


def poisson_mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    power: float = 0.5,
    epochs: float = 1.0,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` replicated and shuffled: all columns, and copy (1, 2, ... for each document).

    A document's count is drawn from the Poisson distribution whose mean is its source's rate
    (``source_rates``), by a draw that is a hash of seed, id and text; equal runs give equal
    rows. The copies are put in a global random order by a range sort on a hash of seed, id,
    text and copy.

    A null source is a source of its own; null and empty texts have no characters but are drawn
    like the rest of their source. Rows that are equal in id and text get equal counts. A column
    of the input named copy is replaced. An empty table gives an empty table.
    """
    rates = source_rates(docs, weights, source_col, text_col, power, epochs)
    counted = poisson_counts(docs, rates, id_col, text_col, source_col, seed).filter("_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.expr("sequence(1, _copies)"))).drop("_copies")
    return copies.orderBy(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text_col), F.col("copy")))
