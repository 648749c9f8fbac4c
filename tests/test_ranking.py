import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gradewell.operators import ranking as R
from gradewell.operators.numbering import numbered, numbered_by_id, swept
from gradewell.operators.scoring import attempt_history, question_scores
from tests.conftest import rows


def test_numbering_equals_a_plain_sort(spark):
    rng = random.Random(7)
    # one group holds most rows; many ties
    data = [(1 if rng.random() < 0.7 else rng.randrange(2, 9), rng.randrange(1 << 23), rng.randrange(6)) for _ in range(4000)]
    data = list({(g, i): (g, i, p) for g, i, p in data}.values())
    df = spark.createDataFrame(data, "g long, i long, p long")
    got = numbered(df.repartition(7), [F.desc("p"), F.col("i")], by=["g"])
    want, place = [], {}
    for g, i, p in sorted(data, key=lambda r: (r[0], -r[2], r[1])):
        place[g] = place.get(g, 0) + 1
        want.append((g, i, p, place[g]))
    assert rows(got) == sorted(want, key=repr)


def test_one_global_list(spark):
    ids = [5, 1 << 20, (1 << 20) + 1, 3 << 21, 7]
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    got = {r.i: r.place for r in numbered_by_id(df, "i").collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(ids))}


def test_places_keep_gaps(spark):
    ranking = spark.createDataFrame([(1, 7, 5.0), (2, 7, 4.0), (3, 7, 4.0), (4, 7, 1.0)], "id_uz long, id_grupy long, pkt double")
    users = spark.createDataFrame([(i, f"u{i}", "user") for i in range(1, 5)], "id_uz long, nazwa_uz string, ranga string")
    groups = spark.createDataFrame([(7, 4)], "id_grupy long, id_wlasciciela long")
    access = spark.createDataFrame(
        [(7, 1, "1100000000000000"), (7, 2, "0000000000000000"), (7, 3, "1000000000000000")],
        "id_grupy long, id_uz long, prawa_dost string",
    )
    board = R.leaderboard(ranking, users, groups, access)
    assert rows(board, "place", "id_uz") == [(1, 1), (3, 3), (4, 4)]


def test_ranking_is_the_sum_of_best_attempts(domain):
    scores = question_scores(domain.odpowiedz_uzytkownika, domain.pytanie, domain.typ, domain.odpowiedz_wzorcowa)
    best = {}
    group = {r.id_quizu: r.id_grupy for r in domain.quiz.collect()}
    for r in attempt_history(scores).collect():
        key = (r.id_uz, r.id_quizu)
        best[key] = max(best.get(key, 0.0), r.zdobyte_pkt)
    want = {}
    for (user, quiz), points in best.items():
        if group[quiz]:
            want[user, group[quiz]] = want.get((user, group[quiz]), 0.0) + points
    got = {(r.id_uz, r.id_grupy): r.pkt for r in domain.ranking.collect()}
    assert got == {k: round(v, 6) for k, v in want.items()}


def test_recomputing_all_groups_gives_the_ranking(domain):
    groups = domain.grupa_quizowa.filter("id_grupy <> 0").select("id_grupy")
    stale = domain.ranking.withColumn("pkt", F.lit(-1.0))
    again = R.recompute_group_ranking(
        stale, groups, domain.odpowiedz_uzytkownika, domain.pytanie, domain.typ, domain.odpowiedz_wzorcowa, domain.quiz
    )
    assert rows(again, "id_uz", "id_grupy", "pkt") == rows(domain.ranking, "id_uz", "id_grupy", "pkt")


def test_attempt_rules(spark):
    attempts = spark.createDataFrame(
        [(1, 1, "2020-01-01", 3.0), (1, 1, "2020-01-02", 2.0), (1, 2, "2020-01-01", 1.0)],
        "id_uz long, id_quizu long, t string, zdobyte_pkt double",
    ).withColumn("data_wyslania", F.col("t").cast("timestamp_ntz"))
    quizzes = spark.createDataFrame([(1, 5), (2, 0)], "id_quizu long, id_grupy long")
    assert rows(R.ranking_from_attempts(attempts, quizzes)) == [(1, 5, 3.0)]
    assert rows(R.ranking_from_attempts(attempts, quizzes, "last")) == [(1, 5, 2.0)]
    assert rows(R.ranking_from_attempts(attempts, quizzes, "sum", include_limbo=True)) == [(1, 0, 1.0), (1, 5, 5.0)]


@pytest.fixture()
def many_parts(spark):
    """Ranges are not joined together again, so that small tables lie in several parts."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


def test_hashed_ids_and_a_hot_group(many_parts):
    """Places are those of a sort, whatever the spread of ids and the size of a group."""
    n = 200_000
    df = many_parts.range(n).select(F.xxhash64("id").alias("i"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("g"))
    places = numbered_by_id(df, "i").agg(F.count_distinct("place"), F.min("place"), F.max("place")).first()
    assert tuple(places) == (n, 1, n)
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("i")).cast("long"))
    got = numbered_by_id(df, "i", ["g"])
    assert got.exceptAll(want).count() == 0 and got.count() == n


def test_running_sums(many_parts):
    rng = random.Random(11)
    data = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, rng.randrange(40)]), k, rng.randrange(5)) for k in range(3000)]
    df = many_parts.createDataFrame(data, "g long, o long, k long, n long")
    got = swept(df, [F.col("o")], {"s": F.col("n"), "c": F.lit(1)}, by=["g"], ties=[F.desc("k")])
    want, held = [], {}
    for g, o, k, n in sorted(data, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], -r[2])):
        s, c = held.get(g, (0, 0))
        held[g] = (s + n, c + 1)
        want.append((g, o, k, n, s + n, c + 1))
    assert rows(got) == sorted(want, key=repr)
    assert swept(df.limit(0), [F.col("o")], {"s": F.col("n")}).count() == 0


def test_input_is_worked_out_once(many_parts):
    """What reads the sweep's result never goes back to its input."""
    source = many_parts.range(1000).select((F.col("id") % 5).alias("g"), F.xxhash64("id").alias("i"))
    plan = numbered_by_id(source, "i", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in plan and plan.count("FileScan") == 2
    carried = [line for line in plan.splitlines() if "BroadcastExchange" in line]
    assert len(carried) == 1  # one row a part


def test_paths_keep_their_order(spark):
    paths = [f"file:///{a}/{b}{c}/{d}" for a in "pq" for b in ("r", "r-s", "r/t/u/v/w") for c in ("", "/x", "!") for d in ("1", "z", "zz")]
    df = spark.createDataFrame([(p,) for p in paths], "zrodlo string")
    got = [r.zrodlo for r in numbered(df, [F.col("zrodlo")]).orderBy("place").collect()]
    assert got == sorted(paths)
