"""Exact deduplication in two passes over a Bloom filter, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import store
from gradewell.operators.skew import own_shuffle

#: Bits of the filter for each row, at least. One row sets two bits of one 64-bit word.
BITS_PER_ROW = 16


def normal_text(text: Column) -> Column:
    """Each run of space, tab or line ends as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; of equal texts the smallest id stays.
    1. Each text is read once and becomes its SHA-256, which is stored.
    2. First pass: every row adds its two bits to its word of the filter; bits that were added
       only once are cleared. The filter grows with the rows and is a table of words, shuffled
       as counts of bits, never one object.
    3. Second pass: a row is possibly repeated if both of its bits are still there. Only such
       rows are grouped; the others are unique and pass through. A false alarm is a group of one.

    Nulls count as empty texts; empty texts are equal to each other. Rows with the same id and
    equal texts stay separate rows, each with the same keep_id. A null id is never the one that
    stays unless all ids of its group are null. An empty table gives an empty table.
    """
    digest = F.sha2(normal_text(F.col(text_col)), 256)
    rows = store(docs.select(F.col(id_col).alias("id"), digest.alias("sha")), "digests")
    words = max(1, rows.count() * BITS_PER_ROW // 64)
    h = F.xxhash64("sha")
    bits = [F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int") for at in (0, 6)]
    rows = rows.withColumns({"word": F.pmod(F.shiftrightunsigned(h, 12), F.lit(words)), "bits": F.array(*bits)})

    repeated = (
        rows.select("word", F.explode(F.array_distinct("bits")).alias("bit"))
        .groupBy("word", "bit")
        .count()
        .filter(F.col("count") > 1)
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("there"))
    )
    probed = rows.join(own_shuffle(repeated, "word"), "word", "left")
    mask = F.expr("shiftleft(1L, bits[0]) | shiftleft(1L, bits[1])")
    hit = F.coalesce(F.col("there").bitwiseAND(mask) == mask, F.lit(False))
    probed = store(probed.select("id", "sha", hit.alias("possible")), "probed")

    suspects = probed.filter("possible")
    groups = suspects.groupBy("sha").agg(F.min("id").alias("keep"), F.count("*").alias("size"))
    grouped = suspects.join(own_shuffle(groups, "sha"), "sha").select("id", "sha", "keep", "size")
    alone = probed.filter(~F.col("possible")).select("id", "sha", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"))
    return grouped.union(alone).select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.coalesce(F.col("id") == F.col("keep"), F.col("keep").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
