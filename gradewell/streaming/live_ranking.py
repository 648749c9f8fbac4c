"""Rankings kept up to date by a stream of submissions.

Two streaming queries share one path. The first, the intake, judges and scores each micro-batch of
forms and appends to tables that have a folder per batch: ``judged`` (all forms, with what the gates
say), ``refused`` (those that do not pass), ``members`` (memberships that entering a group has made), ``answers`` and ``attempts`` (one
short row per attempt). The second reads the attempts as they come and keeps, as state of
each (user, group) pair, the different results of each quiz; the pairs of a batch are appended
to ``ranking`` with the sum of the best. It is an aggregation of Spark's own, without Python in the
tasks. Nobody reads old answers or attempts again: what a batch costs depends on the batch.

Nothing is counted twice. A batch that runs again writes its own folders again, and a best attempt
stays what it is when it is seen once more, so attempts may even be delivered twice. The present
ranking is the latest row of each pair; every ``FOLD`` batches the log is folded into a
base, so readers see a base and the few batches after it.

A submitted form must arrive whole, i.e. its rows in one file of the stream.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradewell.functions.scalar import POINT_DIGITS
from gradewell.operators.changes import expand_submissions, judged_submissions, shown_options, sorted_submissions
from gradewell.operators.scoring import attempt_history, question_scores
from gradewell.schema import LIMBO_GROUP

ATTEMPT = "id_uz long, id_quizu long, zdobyte_pkt double"
TOTAL = "id_uz long, id_grupy long, pkt double"
MEMBER = "id_grupy long, id_uz long, prawa_dost string"
NO_BATCH = -1
#: Batches of the ranking's log after which it is folded into a new base.
FOLD = 16
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class QuizTables:
    """The tables a submission is checked against."""

    questions: DataFrame
    types: DataFrame
    templates: DataFrame
    quizzes: DataFrame
    groups: DataFrame
    access: DataFrame


def _write(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").parquet(folder)


def _store(df: DataFrame, path: str, table: str, nr: int) -> DataFrame:
    """Writes a batch's rows to their folder and reads them back, so later steps do not redo them."""
    folder = f"{path}/{table}/batch={nr}"
    _write(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


# Forms to attempts --------------------------------------------------------------
def start_intake(submissions: DataFrame, tables: QuizTables, path: str, seed: str, **trigger) -> StreamingQuery:
    """Starts judging and scoring the forms; ``trigger`` is passed on, e.g. ``availableNow=True``."""
    spark = submissions.sparkSession
    for table, schema in (("members", MEMBER), ("attempts", ATTEMPT)):
        # an empty first batch, the same at every start
        _write(spark.createDataFrame([], schema), f"{path}/{table}/batch={NO_BATCH}")
    return (
        submissions.writeStream.foreachBatch(lambda batch, nr: take_batch(batch, nr, tables, path, seed))
        .option("checkpointLocation", f"{path}/checkpoint-intake")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_members(spark: SparkSession, path: str, access: DataFrame, below: int = 1 << 62) -> DataFrame:
    """The membership rows that the stream began with and those it has made in batches under ``below``."""
    made = spark.read.schema(f"{MEMBER}, batch long").parquet(f"{path}/members").filter(F.col("batch") < below)
    columns = ["id_grupy", "id_uz", "prawa_dost"]
    return access.select(columns).unionByName(made.select(columns))


def take_batch(batch: DataFrame, nr: int, tables: QuizTables, path: str, seed: str) -> None:
    """One micro-batch: forms judged by the memberships of this moment, answers, attempts."""
    spark = batch.sparkSession
    access = current_members(spark, path, tables.access, below=nr)
    judged = _store(judged_submissions(batch, tables.quizzes, tables.groups, access), path, "judged", nr)
    accepted, refused, entered = sorted_submissions(judged)
    _write(refused, f"{path}/refused/batch={nr}")
    _write(entered, f"{path}/members/batch={nr}")
    shown = shown_options(batch, tables.questions, tables.types, tables.templates, seed, accepted)
    answers = _store(expand_submissions(shown)[0], path, "answers", nr)
    scores = question_scores(answers, tables.questions, tables.types, tables.templates)
    _write(attempt_history(scores).select("id_uz", "id_quizu", "zdobyte_pkt"), f"{path}/attempts/batch={nr}")


# Attempts to totals -------------------------------------------------------------
UNIT = 10**POINT_DIGITS


def _sum_of_best() -> Column:
    """Points of a (user, group) pair: the best attempt of each quiz, summed. The state is the set of
    (quiz, points) that occurred, so a quiz has an entry for each of its different results. Points are
    whole numbers of their last digit, so sums are exact in any order."""
    gained = F.round(F.col("zdobyte_pkt") * UNIT).cast("long").alias("n")
    results = F.array_sort(F.collect_set(F.struct("id_quizu", gained)))
    best = F.filter(results, lambda x, i: F.coalesce(F.get(results["id_quizu"], i + 1) != x["id_quizu"], F.lit(True)))
    return F.aggregate(best, F.lit(0).cast("long"), lambda total, x: total + x["n"]) / UNIT


def start_totals(spark: SparkSession, quizzes: DataFrame, path: str, files: int | None = None, **trigger) -> StreamingQuery:
    """Starts keeping the totals of the attempts under ``path``; ``files`` bounds the files of a
    micro-batch. The state lives in RocksDB, under the query's checkpoint."""
    spark.conf.set(STATE_STORE, ROCKSDB)
    source = spark.readStream.schema(f"{ATTEMPT}, batch long").option("ignoreMissingFiles", "true")
    attempts = (source.option("maxFilesPerTrigger", files) if files else source).parquet(f"{path}/attempts")
    groups = quizzes.select("id_quizu", "id_grupy").filter(F.col("id_grupy") != LIMBO_GROUP)
    totals = attempts.join(groups, "id_quizu").groupBy("id_uz", "id_grupy").agg(_sum_of_best().alias("pkt"))
    _write(spark.createDataFrame([], TOTAL), f"{path}/ranking_base/upto={NO_BATCH}")
    return (
        totals.writeStream.foreachBatch(lambda changed, nr: _append(changed, nr, path))
        .outputMode("update")
        .option("checkpointLocation", f"{path}/checkpoint-totals")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _append(changed: DataFrame, nr: int, path: str) -> None:
    if nr and nr % FOLD == 0:
        fold(changed.sparkSession, path, nr - 1)
    _write(changed, f"{path}/ranking/batch={nr}")


def _since_base(spark: SparkSession, path: str, below: int) -> DataFrame:
    """Rows of the newest base older than batch ``below`` and of the batches after it, with ``batch``."""
    bases = spark.read.schema(f"{TOTAL}, upto long").parquet(f"{path}/ranking_base").filter(F.col("upto") < below)
    newest = bases.agg(F.max("upto")).first()[0]
    newest = NO_BATCH if newest is None else newest
    base = bases.filter(F.col("upto") == newest).withColumnRenamed("upto", "batch")
    log = spark.read.schema(f"{TOTAL}, batch long").parquet(f"{path}/ranking")
    return base.unionByName(log.filter((F.col("batch") > newest) & (F.col("batch") < below)))


def _latest(totals: DataFrame) -> DataFrame:
    return totals.groupBy("id_uz", "id_grupy").agg(F.max_by("pkt", "batch").alias("pkt"))


def fold(spark: SparkSession, path: str, upto: int) -> None:
    """Folds the ranking's log up to batch ``upto``, which must be finished for good, into a new base."""
    _write(_latest(_since_base(spark, path, upto + 1)), f"{path}/ranking_base/upto={upto}")


def current_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Latest total of every (user, group) pair."""
    return _latest(_since_base(spark, path, 1 << 62))


def catch_up(submissions: DataFrame, tables: QuizTables, path: str, seed: str, files: int | None = None) -> DataFrame:
    """Takes in all forms that are there and returns the ranking. Goes on where it stopped before."""
    spark = submissions.sparkSession
    start_intake(submissions, tables, path, seed, availableNow=True).awaitTermination()
    start_totals(spark, tables.quizzes, path, files, availableNow=True).awaitTermination()
    return current_ranking(spark, path)


def replay(
    spark: SparkSession, submissions: DataFrame, tables: QuizTables, path: str, seed: str, files: int = 4
) -> DataFrame:
    """Runs stored submissions through the stream, two files at a time, and returns the ranking."""
    schema = submissions.schema
    submissions.repartition(files, "id_uz", "data_wyslania").write.parquet(f"{path}/inbox")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/inbox")
    return catch_up(stream, tables, path, seed)
