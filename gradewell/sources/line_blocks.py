"""Questions from text in fixed-size line blocks: a question line, then its answers."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewell.functions.scalar import block_of, slot_of, strip
from gradewell.sources.shared import stored

BLOCK = ["zrodlo", "blok"]


def question_blocks(lines: DataFrame, stride: int) -> DataFrame:
    """Blocks from numbered lines (zrodlo, nr_linii from 0, linia).

    A block holds at most ``stride`` lines whatever the text, so grouping by
    (source, block) spreads even one huge source. A short last block is kept.
    """
    slotted = lines.select(
        "zrodlo",
        block_of("nr_linii", stride).alias("blok"),
        slot_of("nr_linii", stride).cast("int").alias("_slot"),
        strip("linia").alias("_linia"),
    )
    answers = F.when(F.col("_slot") > 0, F.struct("_slot", "_linia"))
    return (
        slotted.groupBy(*BLOCK)
        .agg(
            F.max(F.when(F.col("_slot") == 0, F.col("_linia"))).alias("pytanie"),
            F.sort_array(F.collect_list(answers)).alias("_a"),
        )
        .select(*BLOCK, "pytanie", F.col("_a._linia").alias("odpowiedzi"))
    )


def text_lines(texts: DataFrame, source: str, text: str) -> DataFrame:
    """Numbered lines of a table that holds one whole text per row.

    A final line end does not start another line.
    """
    whole = F.regexp_replace(F.col(text), r"\r?\n\z", "")
    return texts.filter(F.length(text) > 0).select(
        F.col(source).alias("zrodlo"), F.posexplode(F.split(whole, r"\r?\n")).alias("nr_linii", "linia")
    )


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of text files, large files being read in splits.

    The files are read once: each line is stored with its split, the byte that it begins at, and
    its place in the split; what the splits hold, summed up in the order of the bytes, gives each
    its offset. A line that reaches over several splits belongs to the one it begins in. Lines end
    with a line feed, with or without a carriage return. Offsets come from the stored lines, so
    they stay right whatever splits another reading would make.
    """
    raw = stored(
        spark.read.option("lineSep", "\n").text(path).select(
            F.col("_metadata.file_path").alias("zrodlo"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_id"),
            F.regexp_replace("value", "\r$", "").alias("linia"),
        ),
        "lines",
    )
    before = Window.partitionBy("zrodlo").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        raw.groupBy("zrodlo", "_start")
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    return raw.join(splits, ["zrodlo", "_start"]).select(
        "zrodlo", (F.col("_offset") + F.col("_id") - F.col("_first")).alias("nr_linii"), "linia"
    )


def read_question_blocks(spark: SparkSession, path: str, stride: int) -> DataFrame:
    return question_blocks(file_lines(spark, path), stride)
