"""Rows that go to disk in shuffles. Where no table is broadcast, their number is what decides
whether a large run fits the disks."""

import os

import pytest

from gradewell.operators import numbering
from gradewell.plans import registry
from gradewell.sources.testrequests import Requests
from tests.conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="no test tables")

#: Queries, and the most rows that they may shuffle for each row of the answers.
MOST = {
    "question_scores": 2.5,
    "expand_submissions": 1.5,  # the largest step of submit_ranking and of the stream
    "question_page": 2.5,
    "attempt_history": 3,
    "recompute_ranking": 3,
    "recompute_ranking_last": 3,
    "recompute_ranking_sum": 3,
    "recompute_group_ranking": 3,
    "transfer_to_group_ranking": 3.5,
    "leaderboard": 3,
    "leaderboard_raw": 3,
    "ranking_with_user": 3,
    "delete_users_ranking": 3,
    "delete_groups_ranking": 3,
    "answer_ids": 4,
    "check_not_null": 3,
}


@pytest.fixture()
def no_broadcasts(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffled(df) -> int:
    """Rows that the shuffles of a query have written. What is reused counts once."""
    df.collect()

    def walk(node) -> int:
        name = node.getClass().getSimpleName()
        if name == "ReusedExchangeExec":
            return 0
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        below = node.children()
        return own + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def n_answers(spark):
    return Requests(spark, SF_SMALL).odpowiedz_uzytkownika.count()


@pytest.mark.parametrize("name", MOST)
def test_few_rows_are_shuffled(spark, no_broadcasts, n_answers, monkeypatch, name):
    monkeypatch.setattr(numbering, "stored", lambda df, purpose: df)  # steps that are stored stay in the plan
    assert shuffled(registry.queries()[name](spark, SF_SMALL)) <= MOST[name] * n_answers


def test_attempts_are_scored_once_for_both_batches(spark):
    for batch in registry._attempt_batches(Requests(spark, SF_SMALL)):
        plan = batch._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" in plan and "orders.parquet" not in plan
