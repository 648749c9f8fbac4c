"""The queries of this subpackage, each an operator over its whole table, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import (
    bloom_dedup,
    html_suffix,
    line_chunks,
    oracle,
    packing,
    poisson_mix,
    ppm_language,
    prefix_trie,
    qgram_decontam,
    rff_quality,
    seekable,
    set_join,
    url_templates,
    whitening,
)
from gradewell.llm.common import crc_share, store, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
PACKED_END_ID = 1


#: The rules that a url is judged by before its template.
RULES = [
    url_templates.Rule("com", "/", "allow"),
    url_templates.Rule("example.com", "/en/", "block"),
    url_templates.Rule("www.example.com", "/en/", "allow"),
    url_templates.Rule("net", "/es/", "block"),
    url_templates.Rule("net", "/fr/", "block"),
]


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op2_html_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_suffix.extract(table(spark, sf_dir, "pages"))


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.poisson_mix(table(spark, sf_dir, "documents"))


def op4_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = rff_quality.quality_scores(docs, labels, learn=crc_share("doc_id", 3) != 1)
    return scores.select("doc_id", (crc_share("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5_qgram_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram_decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = seekable.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.line_dedup(table(spark, sf_dir, "documents"), own_line=line_chunks.LONG_LINE)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ppm_language.identify(table(spark, sf_dir, "documents"), learn=crc_share("doc_id", 4) != 2)
    return found.select("doc_id", (crc_share("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), PACKED_END_ID)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = store(prefix_trie.turn_lists(table(spark, sf_dir, "conversations")), "turns")
    base = F.col("conv_id") - F.col("conv_id") % 20
    rebuilt = prefix_trie.with_heads(own, base, crc_share("conv_id", 4).cast("int"), most=3)
    nodes = prefix_trie.prefix_trie(rebuilt)
    return nodes.withColumn("depth", F.col("depth").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_templates": op1_url_templates,
        "op2_html_suffix": op2_html_suffix,
        "op3_poisson_mix": op3_poisson_mix,
        "op4_rff_quality": op4_rff_quality,
        "op5_qgram_decontam": op5_qgram_decontam,
        "op6_token_files": op6_token_files,
        "op7_line_dedup": op7_line_dedup,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_ppm_language": op9_ppm_language,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_packing": op11_packing,
        "op12_whitening": op12_whitening,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_jaccard_join": oracle.OP8, "op10_exact_dedup": oracle.OP10, "op13_prefix_trie": oracle.OP13}
