"""Rankings and counts kept up to date by what changes, without reading the rest.

Counts and sums take signed changes: a row that comes adds, a row that goes takes away. A best
attempt only grows while attempts come; where the best one itself goes, the attempts of that
(user, quiz) are read again, and only those. Attempts lie in buckets of users, so such a
reading opens the buckets of the users concerned and no others.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions.scalar import points
from gradewell.operators.access import is_superuser, not_limbo_user
from gradewell.operators.skew import own_shuffle
from gradewell.schema import LIMBO_GROUP

BUCKETS = 64
ATTEMPT = ["id_uz", "id_quizu", "data_wyslania", "zdobyte_pkt"]


def user_bucket(buckets: int = BUCKETS, user: str = "id_uz") -> Column:
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


# Counts -------------------------------------------------------------------------
def signed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that came (+1) and went (-1) between two states of a list of keys, once each."""
    both = before.select(*keys, F.lit(-1).alias("_n")).unionByName(after.select(*keys, F.lit(1).alias("_n")))
    return both.groupBy(*keys).agg(F.sum("_n").alias("zmiana")).filter("zmiana <> 0")


def changed_counts(counts: DataFrame, changes: DataFrame, key: str, name: str) -> DataFrame:
    """``counts`` (key, name) after ``changes`` (key, zmiana): one row a key meets them, however
    many rows changed. A key that was not counted before is added."""
    by_key = changes.groupBy(key).agg(F.sum("zmiana").alias("_zmiana"))
    total = F.coalesce(name, F.lit(0)) + F.coalesce("_zmiana", F.lit(0))
    return counts.join(own_shuffle(by_key, key), key, "full").select(key, total.alias(name))


def changed_member_counts(counts: DataFrame, changes: DataFrame, users: DataFrame) -> DataFrame:
    """``member_counts`` after membership changes (id_grupy, id_uz, zmiana); superusers and the
    limbo user are not counted."""
    counted = users.filter(~is_superuser() & not_limbo_user()).select("id_uz")
    return changed_counts(counts, changes.join(counted, "id_uz", "left_semi"), "id_grupy", "uzytkownicy")


def changed_quiz_counts(counts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``active_quiz_counts`` after quizzes changed from ``before`` to ``after`` (the changed ones
    only): made, deleted, moved, hidden or shown."""
    active = [q.filter(~F.col("ukryty")).select("id_grupy", "id_quizu") for q in (before, after)]
    return changed_counts(counts, signed(*active, ["id_grupy", "id_quizu"]), "id_grupy", "quizy")


def changed_orphans(
    orphans: DataFrame, moves: DataFrame, lost: DataFrame, found: DataFrame, parents: DataFrame, children: DataFrame
) -> DataFrame:
    """``orphans`` (tabela, klucz, wartosc, wiersze) of one parent table after changes.

    ``moves``: child rows that came or went (tabela, klucz, wartosc, zmiana); ``lost`` and ``found``:
    parents' keys that went and came (wartosc). Only values that these name are looked up in
    ``parents`` (wartosc), the keys that are there now. A value that was an orphan's takes the
    difference; of one that has become so, the rows of ``children`` (tabela, klucz, wartosc), as
    they are now, are counted.
    """
    by = ["tabela", "klucz", "wartosc"]
    concerned = moves.select("wartosc").union(lost.select("wartosc")).union(found.select("wartosc")).distinct()
    there = concerned.join(parents.select("wartosc"), "wartosc", "left_semi")
    difference = moves.groupBy(*by).agg(F.sum("zmiana").alias("_zmiana"))
    kept = orphans.join(there, "wartosc", "left_anti").join(difference, by, "left")
    kept = kept.select(*by, (F.col("wiersze") + F.coalesce("_zmiana", F.lit(0))).alias("wiersze")).filter("wiersze > 0")
    absent = concerned.join(there, "wartosc", "left_anti")
    fresh = children.join(absent, "wartosc", "left_semi").groupBy(*by).agg(F.count("*").alias("wiersze"))
    return kept.unionByName(fresh.join(orphans.select(*by), by, "left_anti"))


# Rankings -----------------------------------------------------------------------
def write_attempts(attempts: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> None:
    """Appends a batch of attempts (``ATTEMPT``, and zmiana: 1 comes, -1 goes) to the log, in
    folders of the users' buckets. A batch that is written again replaces itself."""
    rows = attempts.select(*ATTEMPT, "zmiana", user_bucket(buckets).alias("kubelek"))
    rows.repartition("kubelek").write.mode("overwrite").partitionBy("kubelek").parquet(f"{path}/paczka={batch}")


def read_attempts(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The attempts that count now, of the users in ``buckets`` (all by default)."""
    log = spark.read.option("basePath", path).parquet(f"{path}/paczka=*")
    if buckets is not None:
        log = log.filter(F.col("kubelek").isin(buckets))
    return log.groupBy(*ATTEMPT).agg(F.sum("zmiana").alias("_n")).filter("_n > 0").select(*ATTEMPT)


def changed_best(
    best: DataFrame, changes: DataFrame, path: str, buckets: int = BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """The best attempts (id_uz, id_quizu, best) after ``changes``, which are in the log at ``path``
    already, and the (user, quiz) pairs with what they had before and have now.

    Where no attempt as good as the best went, the best of old and new holds. Else the pair's
    attempts are read again. At most ``buckets`` numbers of folders reach the driver.
    """
    spark, pair = best.sparkSession, ["id_uz", "id_quizu"]
    came = F.max(F.when(F.col("zmiana") > 0, F.col("zdobyte_pkt"))).alias("_came")
    went = F.max(F.when(F.col("zmiana") < 0, F.col("zdobyte_pkt"))).alias("_went")
    touched = changes.groupBy(*pair).agg(came, went).join(best, pair, "left")
    shaken = F.coalesce(F.col("_went") >= F.greatest("best", "_came"), F.lit(False))
    again = touched.filter(shaken).select(*pair)
    folders = [r[0] for r in again.select(user_bucket(buckets)).distinct().collect()]
    reread = read_attempts(spark, path, folders).join(again, pair, "left_semi")
    reread = reread.groupBy(*pair).agg(F.max("zdobyte_pkt").alias("_reread"))
    now = F.when(shaken, F.col("_reread")).otherwise(F.greatest("best", "_came"))
    moved = touched.join(reread, pair, "left").select(*pair, F.col("best").alias("przed"), now.alias("po"))
    kept = best.join(moved.select(*pair), pair, "left_anti")
    return kept.unionByName(moved.filter("po IS NOT NULL").select(*pair, F.col("po").alias("best"))), moved


def changed_ranking(ranking: DataFrame, moved: DataFrame, quizzes: DataFrame) -> DataFrame:
    """The ranking after ``changed_best``: sums take the differences, and a user who has no attempt
    in a group any more leaves it. ``ranking`` has the number of quizzes behind each row (``quizy``)."""
    groups = quizzes.select("id_quizu", "id_grupy").filter(F.col("id_grupy") != LIMBO_GROUP)
    zero = F.lit(0.0)
    gained = F.sum(F.coalesce("po", zero) - F.coalesce("przed", zero)).alias("_pkt")
    more = F.sum(F.col("po").isNotNull().cast("int") - F.col("przed").isNotNull().cast("int")).alias("_quizy")
    by_pair = moved.join(groups, "id_quizu").groupBy("id_uz", "id_grupy").agg(gained, more)
    total = points(F.coalesce("pkt", zero) + F.coalesce("_pkt", zero)).alias("pkt")
    number = (F.coalesce("quizy", F.lit(0)) + F.coalesce("_quizy", F.lit(0))).alias("quizy")
    return ranking.join(by_pair, ["id_uz", "id_grupy"], "full").select("id_uz", "id_grupy", total, number).filter("quizy > 0")
