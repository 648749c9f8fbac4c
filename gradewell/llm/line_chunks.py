"""Line deduplication over content-defined chunks of lines, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import store
from gradewell.operators.skew import own_shuffle

#: A boundary follows a line where the rolling hash of the last WINDOW lines is 0 modulo EVERY.
WINDOW, EVERY = 2, 3
#: op7: a line of more words than this is a passage of its own.
LONG_LINE = 50
#: Repeated hashes, and documents that lose lines, are broadcast up to so many (some ten MB each)
#: and joined beyond, which then shuffles the texts.
BROADCAST_ROWS = 1_000_000


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_long(line: Column, words: int) -> Column:
    """Whether a line has more than ``words`` words."""
    return line.rlike(rf"^\s*+(?:\S++\s++){{{words}}}\S")


def line_chunks(text: Column, window: int = WINDOW, every: int = EVERY, own_line: int | None = None) -> Column:
    """The chunks of a text as an array of (seq, first, last, body): line numbers from 0, and the
    chunk's lines. A boundary depends on the last ``window`` lines only, so lines added or removed
    elsewhere do not move it. Where ``own_line`` is given, a line of more words than that has a
    boundary before and after it too."""

    def rolled(hashes: Column, i: Column) -> Column:
        out = F.get(hashes, i)
        for back in range(1, window):
            before = F.coalesce(F.get(hashes, i - back), F.lit(0))
            out = out.bitwiseXOR(F.shiftleft(before, 7 * back).bitwiseOR(F.shiftrightunsigned(before, 64 - 7 * back)))
        return out

    def cut(lines: Column) -> Column:
        hashes = F.transform(lines, lambda line: F.xxhash64(line))
        last = F.size(lines) - 1

        def ends_of(found: Column) -> Column:
            numbers = F.sequence(F.lit(0), last)
            rolls = lambda i: (F.pmod(F.xxhash64(rolled(found, i)), F.lit(every)) == 0) | (i == last)
            if own_line is None:
                return F.filter(numbers, rolls)
            flags = F.transform(lines, lambda line: is_long(line, own_line))
            return let(flags, lambda long: F.filter(numbers, lambda i: rolls(i) | F.get(long, i) | F.coalesce(F.get(long, i + 1), F.lit(False))))

        def chunks(ends: Column) -> Column:
            def chunk(end: Column, k: Column) -> Column:
                first = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)
                body = F.array_join(F.slice(lines, first + 1, end - first + 1), "\n")
                return F.struct(k.alias("seq"), first.alias("first"), end.alias("last"), body.alias("body"))

            return F.transform(ends, chunk)

        return let(hashes, lambda found: let(ends_of(found), chunks))

    return let(F.split(text, "\n"), cut)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, every: int = EVERY, own_line: int | None = None
) -> DataFrame:
    """One row per document: id_col, text (without repeated chunks), n_lines, n_removed (lines).

    A document's lines are cut into chunks (``line_chunks``). A chunk of several lines, with a
    word in it, that occurs more than once in the corpus stays where it comes first, by document
    id and place, and is removed elsewhere, in the same document too. Chunks are found by a 64-bit
    hash and compared byte by byte before one is removed. Chunks of one line always stay.

    Where ``own_line`` is given, as in op7, the lines are also cut a second time, with boundaries
    around each line of more words than that, and such a line is removed like a chunk of several
    lines. What either cut finds goes; the first occurrence of every line stays, since a line is
    only removed for an earlier equal one.

    1. Only chunks whose hash lies in several places go on, with their bytes.
    2. Equal bytes are grouped, map-side first, to find the first of each.
    3. The places to be removed meet the documents, whose lines are put together again.

    A null text stays null with no lines; an empty text has one empty line. Ids name one text
    each: of rows with the same id and text, every chunk counts as the same place. Rows with a
    null id are returned unchanged. An empty table gives an empty table.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    cuts, several = [line_chunks(F.col("body"), window, every)], F.col("last") > F.col("first")
    if own_line is not None:
        cuts.append(line_chunks(F.col("body"), window, every, own_line))
        several |= is_long(F.col("body"), own_line)
    pieces = [F.transform(c, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["body"].alias("body"))) for c in cuts]
    chunks = plain.filter("id is not null").select("id", F.explode(F.concat(*pieces)).alias("c"))
    chunks = chunks.select("id", "c.*").filter(several & F.col("body").rlike(r"[^\s]")).withColumn("hash", F.xxhash64("body"))

    at = F.xxhash64("id", "first")  # both cuts may give the same chunk
    repeated = chunks.groupBy("hash").agg(F.min(at).alias("low"), F.max(at).alias("high")).filter("low != high").select("hash")
    repeated = store(repeated, "hashes")
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else own_shuffle(repeated, "hash")
    suspects = store(chunks.join(side, "hash", "left_semi"), "chunks")

    place = F.struct("id", "first")
    groups = suspects.groupBy("hash", "body").agg(F.min(place).alias("kept"), F.max(place).alias("top"))
    groups = own_shuffle(groups.filter("kept != top"), "hash")
    found = suspects.join(groups, ["hash", "body"]).filter("struct(id, first) != kept")
    gone = found.groupBy("id").agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    gone = store(gone, "gone").select(F.col("id").alias("gone_id"), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS // 10 else gone

    joined = plain.join(gone, F.col("id") == F.col("gone_id"), "left").drop("gone_id")
    lines = F.split("body", "\n")
    out = F.flatten(F.transform("gone", lambda g: F.sequence(g["first"], g["last"])))
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
    joined = joined.withColumn("stays", F.when(F.col("gone").isNotNull(), stays))
    left = let(lines, lambda found: F.transform("stays", lambda i: F.get(found, i)))
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        F.col("id").alias(id_col),
        kept.alias("text"),
        F.when(F.col("body").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size(lines) - F.size("stays")).alias("n_removed"),
    )
