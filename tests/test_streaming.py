import json

import pytest
from pyspark.sql import functions as F

from gradewell.operators import changes as CH
from gradewell.operators.ranking import ranking_from_attempts, recompute_ranking
from gradewell.streaming import live_ranking as LR
from tests.conftest import rows


def wanted(d, submissions):
    accepted = CH.gate_submissions(submissions, d.quiz, d.grupa_quizowa, d.dostep_grupa)[0]
    shown = CH.shown_options(submissions, d.pytanie, d.typ, d.odpowiedz_wzorcowa, "s", accepted)
    answers = CH.expand_submissions(shown)[0]
    return recompute_ranking(answers, d.pytanie, d.typ, d.odpowiedz_wzorcowa, d.quiz)


def quiz_tables(d):
    return LR.QuizTables(d.pytanie, d.typ, d.odpowiedz_wzorcowa, d.quiz, d.grupa_quizowa, d.dostep_grupa)


def totals(df):
    return rows(df, "id_uz", "id_grupy", "pkt")


def test_stream_equals_batch(spark, domain, tmp_path):
    path, tables = str(tmp_path / "live"), quiz_tables(domain)
    got = LR.replay(spark, domain.submissions, tables, path, "s")
    assert spark.read.parquet(f"{path}/attempts").filter("batch >= 0").select("batch").distinct().count() > 1
    assert totals(got) == totals(wanted(domain, domain.submissions))
    members = CH.gate_submissions(domain.submissions, domain.quiz, domain.grupa_quizowa, domain.dostep_grupa)[2]
    assert rows(LR.current_members(spark, path, tables.access)) == rows(members, "id_grupy", "id_uz", "prawa_dost")


def test_restart_and_repeated_batch_do_not_count_twice(spark, domain, tmp_path):
    path, inbox, tables = str(tmp_path / "live"), str(tmp_path / "inbox"), quiz_tables(domain)
    parts = domain.submissions.withColumn("_part", F.abs(F.hash("id_uz", "data_wyslania")) % 2)
    first, second = (parts.filter(F.col("_part") == i).drop("_part") for i in (0, 1))

    def run():
        stream = spark.readStream.schema(domain.submissions.schema).parquet(inbox)
        return LR.catch_up(stream, tables, path, "s")

    first.coalesce(1).write.mode("append").parquet(inbox)
    before = totals(run())
    assert before == totals(wanted(domain, first))
    LR.fold(spark, path, 0)
    assert totals(LR.current_ranking(spark, path)) == before
    second.coalesce(1).write.mode("append").parquet(inbox)
    run()  # new queries on the same checkpoints
    LR.take_batch(second, 1, tables, path, "s")  # the last batch once more, with new files of attempts
    LR.start_totals(spark, tables.quizzes, path).awaitTermination()
    want = totals(wanted(domain, domain.submissions))
    assert totals(LR.current_ranking(spark, path)) == want
    LR.fold(spark, path, 1)
    assert totals(LR.current_ranking(spark, path)) == want
    made = spark.read.parquet(f"{path}/members").groupBy("id_grupy", "id_uz").count()
    assert made.filter("count > 1").count() == 0  # the second batch saw the members of the first


@pytest.fixture()
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_thirty_batches_keep_a_bounded_state(two_partitions, tmp_path):
    spark, path = two_partitions, str(tmp_path / "live")
    quizzes = spark.createDataFrame([(q, q % 3) for q in range(6)], "id_quizu long, id_grupy long")
    every = []
    for nr in range(30):
        batch = [(u, (u + nr + k) % 6, float((7 * nr + 3 * u + k) % 10) / 2) for u in range(20) for k in range(2)]
        every += batch
        spark.createDataFrame(batch, LR.ATTEMPT).coalesce(1).write.parquet(f"{path}/attempts/batch={nr}")
    query = LR.start_totals(spark, quizzes, path, files=1)
    query.awaitTermination()
    progress = [json.loads(p.json) for p in query.recentProgress]
    steps = [p for p in progress if p["numInputRows"]]
    assert len(steps) == 30 and {p["numInputRows"] for p in steps} == {40}  # a batch reads what is new
    pairs, best = {(u, q % 3) for u, q, _ in every if q % 3}, {(u, q) for u, q, _ in every if q % 3}
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in steps]
    assert sizes[-1] == sizes[-5] <= 2 * (len(pairs) + len(best))
    stamped = spark.createDataFrame([(*r, k) for k, r in enumerate(every)], f"{LR.ATTEMPT}, data_wyslania long")
    assert totals(LR.current_ranking(spark, path)) == totals(ranking_from_attempts(stamped, quizzes))
    bases = spark.read.parquet(f"{path}/ranking_base").schema.names
    assert "upto" in bases and (tmp_path / "live" / "ranking_base" / f"upto={LR.FOLD - 1}").exists()


def test_totals_need_no_python_in_tasks(two_partitions, tmp_path):
    spark, path = two_partitions, str(tmp_path / "live")
    quizzes = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "id_quizu long, id_grupy long")
    results = [(1, 0, 0.1), (1, 0, 0.3), (1, 0, 0.2), (1, 1, 0.2), (1, 1, 0.2), (1, 2, 5.0), (2, 1, 0.0)]
    spark.createDataFrame(results, LR.ATTEMPT).write.parquet(f"{path}/attempts/batch=0")
    query = LR.start_totals(spark, quizzes, path)
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "StateStoreSave" in plan and "Python" not in plan and "TransformWithState" not in plan
    assert totals(LR.current_ranking(spark, path)) == [(1, 1, 0.5), (1, 2, 5.0), (2, 1, 0.0)]


def test_a_batch_judges_its_forms_once(spark, domain, tmp_path, monkeypatch):
    looks, look = [], LR.current_members
    monkeypatch.setattr(LR, "current_members", lambda *a, **k: looks.append(a) or look(*a, **k))
    path, tables = str(tmp_path / "live"), quiz_tables(domain)
    LR._write(spark.createDataFrame([], LR.MEMBER), f"{path}/members/batch={LR.NO_BATCH}")
    LR.take_batch(domain.submissions, 0, tables, path, "s")
    judged, refused = (spark.read.parquet(f"{path}/{t}/batch=0") for t in ("judged", "refused"))
    accepted = CH.gate_submissions(domain.submissions, domain.quiz, domain.grupa_quizowa, domain.dostep_grupa)[0]
    assert len(looks) == 1 and judged.count() == refused.count() + accepted.count()
