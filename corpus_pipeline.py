"""A corpus from raw documents to token files, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns
a DataFrame; all but the last return the columns of documents. The result of each is written to
the shared folder as Parquet and read again as the next one's docs.

Stages judge rows, not ids: a row with a null id, and rows with one id, are each judged by their own
text. Null and empty texts are documents like others. An empty table gives an empty table. Columns
that docs have besides those of documents are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import poisson_mix, qgram_decontam, rff_quality, seekable, set_join
from gradewell.llm.common import store, table
from gradewell.llm.queries import END_ID, TOKENIZER

#: Near copies: words in a shingle, and the least similarity in per cent (op8 has its own).
SHINGLE, PERCENT = 5, 80
#: Column for the rows' own numbers while near copies are told.
ROW = "_pipeline_row"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier does not reject; it learns from all their labels."""
    return rff_quality.good_rows(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, null ids last; of
    rows with that id, one. Rows without words are copies of nothing and all stay."""
    rows = store(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")  # written, so numbers stay
    groups = set_join.jaccard_components(rows, id_col=ROW, size=SHINGLE, percent=PERCENT)
    named = groups.select(ROW, "component_id").join(rows.select(ROW, "doc_id"), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first")
    kept = named.groupBy("component_id").agg(first).select(F.col(f"first.{ROW}").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no item of the benchmark."""
    return qgram_decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in a global random order."""
    return poisson_mix.poisson_mix(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, read back: doc_id, start, n_tokens, ids_crc32."""
    read = seekable.token_files(docs, public_tokenizers.path(TOKENIZER), END_ID)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The classifier, the draws and the tokenizer are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
