"""A third of all rows on one key: results stay right and no task gets the whole key."""

import re

import pytest
from pyspark.sql import functions as F

from gradewell.operators import access as AC
from gradewell.operators import catalog as CA
from gradewell.operators import changes as CH
from gradewell.operators import counts as CO
from gradewell.operators import ranking as RA
from gradewell.operators import scoring as SC
from gradewell.operators.sampling import sample_options
from tests.conftest import rows

HOT_QUIZ, HOT_QUESTION, HOT_GROUP = 7, 71, 1

# joins as on big tables: none is small enough to broadcast, and a few kilobytes are a big partition
BIG = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "32",
}


@pytest.fixture
def big(spark):
    before = {k: spark.conf.get(k, None) for k in BIG}
    for k, v in BIG.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tenfold(df):
    """Ten times the rows, for other users."""
    return df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn(
        "id_uz", F.col("id_uz") + 1000 * F.col("_i")
    ).drop("_i")


def third(*keys):
    return F.abs(F.hash(*keys)) % 3 == 0


@pytest.fixture(scope="module")
def hot_answers(domain, tmp_path_factory):
    hot = third("id_uz", "data_wyslania")
    df = tenfold(domain.odpowiedz_uzytkownika).withColumns(
        {
            "tresc_odp": F.when(hot, "A").otherwise(F.col("tresc_odp")),
            "id_pyt": F.when(hot, HOT_QUESTION).otherwise(F.col("id_pyt")),
        }
    )
    path = str(tmp_path_factory.mktemp("hot") / "answers")
    df.repartition(8).write.parquet(path)
    return domain.spark.read.parquet(path)


@pytest.fixture(scope="module")
def hot_draws(domain, tmp_path_factory):
    users = domain.spark.range(100_000).withColumnRenamed("id", "id_uz")
    df = users.select(
        "id_uz", F.when(F.col("id_uz") % 3 == 0, HOT_QUESTION).otherwise((F.col("id_uz") % 150) * 10 + 2).alias("id_pyt")
    )
    path = str(tmp_path_factory.mktemp("hot") / "draws")
    df.repartition(8).write.parquet(path)
    return domain.spark.read.parquet(path)


def split_joins(df) -> int:
    """Number of joins in which AQE split a partition, in the plan that really ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    return len(re.findall(r"Join\(skew=true\)", plan))


def test_popular_question_is_split_when_scored(big, domain, hot_answers):
    scores = SC.question_scores(hot_answers, domain.pytanie, domain.typ, domain.odpowiedz_wzorcowa)
    assert split_joins(scores) >= 1


def test_popular_question_is_split_when_drawn(big, domain, hot_draws):
    drawn, _ = sample_options(hot_draws, domain.pytanie, domain.typ, domain.odpowiedz_wzorcowa, "s")
    assert split_joins(drawn) >= 1


def test_popular_quiz_is_split_when_submitted(big, domain, tmp_path):
    hot = third("id_uz", "data_wyslania")
    forms = tenfold(domain.submissions).withColumn("id_quizu", F.when(hot, HOT_QUIZ).otherwise(F.col("id_quizu")))
    forms.repartition(8).write.parquet(str(tmp_path / "forms"))
    forms = big.read.parquet(str(tmp_path / "forms"))
    shown = CH.shown_options(forms, domain.pytanie, domain.typ, domain.odpowiedz_wzorcowa, "s")
    assert split_joins(CH.expand_submissions(shown)[0]) >= 1


def test_popular_question_is_split_when_its_answers_are_deleted(big, domain, hot_answers):
    asked = big.createDataFrame([(1, 25)], "nr long, id_quizu long")
    left, _ = CH.delete_quiz_answers(asked, hot_answers, domain.pytanie, domain.quiz)
    assert split_joins(left) >= 1


@pytest.fixture(scope="module")
def hot_members(domain, tmp_path_factory):
    """One group holds most memberships."""
    users = domain.spark.range(100_000).withColumnRenamed("id", "id_uz")
    df = users.select(
        F.when(F.col("id_uz") % 4 < 3, HOT_GROUP).otherwise(F.col("id_uz") % 24 + 1).cast("long").alias("id_grupy"),
        "id_uz",
        F.lit("1100000000000000").alias("prawa_dost"),
    )
    path = str(tmp_path_factory.mktemp("hot") / "members")
    df.repartition(8).write.parquet(path)
    return domain.spark.read.parquet(path)


def test_big_group_is_split_in_access_rules(big, domain, hot_members):
    asked = hot_members.select("id_uz", "id_grupy")
    got = AC.has_privileges(
        asked, "participation_in_quizzes", users=domain.uzytkownik, groups=domain.grupa_quizowa, access=hot_members
    )
    assert split_joins(got) >= 1
    assert got.filter("NOT dozwolone").count() == 0


def test_big_group_is_split_in_the_overview(big, domain, hot_members):
    users = hot_members.select("id_uz", F.lit("user").alias("ranga"))
    page = CO.group_overview(
        hot_members.select("id_uz", "id_grupy"), users, domain.grupa_quizowa, hot_members, domain.quiz
    )
    assert split_joins(page) >= 1


def test_popular_text_is_split_when_looked_up(big, domain, hot_answers):
    found = CA.template_lookup(hot_answers.select("id_pyt", "tresc_odp"), domain.odpowiedz_wzorcowa)
    assert split_joins(found) >= 1


def test_results_do_not_depend_on_the_plan(spark, domain, hot_answers):
    def total():
        ranking = RA.recompute_ranking(
            hot_answers, domain.pytanie, domain.typ, domain.odpowiedz_wzorcowa, domain.quiz
        )
        return rows(RA.placed(ranking), "id_grupy", "place", "id_uz", "pkt")

    broadcast = total()
    before = {k: spark.conf.get(k, None) for k in BIG}
    for k, v in BIG.items():
        spark.conf.set(k, v)
    try:
        assert total() == broadcast
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_big_group_is_numbered_in_parts(big, hot_members):
    """The numbering window is keyed by part and group, not by the group alone."""
    from gradewell.operators.numbering import numbered_by_id, swept

    placed = numbered_by_id(hot_members, "id_uz", by=["id_grupy"], name="place")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[sum\(_add_place[^]]*?windowspecdefinition\(([^)]*)", plan)
    assert any("_part" in w for w in windows)
    parts = swept(hot_members, [F.col("id_uz")], {"n": F.lit(1)}, by=["id_grupy"], keep_part=True)
    assert parts.filter(F.col("id_grupy") == HOT_GROUP).select("_part").distinct().count() > 3
