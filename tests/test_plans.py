"""Shapes that must not occur in any plan: products of tables and Python rows."""

import os
import re

import pytest

from gradewell.plans import registry
from tests.conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="no test tables")

# these write and read stored tables, so building them runs jobs
STORED_STEPS = {"live_ranking", "submit_ranking"}


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in STORED_STEPS])
def test_plan(spark, name):
    plan = registry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"NestedLoopJoin|CartesianProduct|EvalPython|PythonUDF|MapInPandas", plan)
    # no numbering window is keyed by a group alone
    for keys in re.findall(r"Window \[row_number\(\) windowspecdefinition\(([^)]*)", plan):
        assert "_part" in keys or "id_pyt" in keys


@pytest.mark.parametrize(
    "name, table, column, pushed",
    [
        ("active_quizzes", "part", "p_size", None),
        ("limbo_quizzes", "part", "p_partkey", "IsNotNull(p_partkey)"),
        ("delete_quizzes_quiz", "part", "p_brand", "In(p_brand"),
        ("is_enrolled", "events", "event_id", None),
    ],
)
def test_scans_read_what_is_needed(spark, name, table, column, pushed):
    plan = registry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and f"{table}.parquet" in line]
    assert scans and all("ReadSchema" in s for s in scans)
    assert any(column in s for s in scans)
    assert not any("p_retailprice" in s or "props" in s for s in scans)
    if pushed:
        assert any(pushed in s.split("PushedFilters")[1] for s in scans)
