"""Operators that are to be native run no Python on the executors."""

import re

import pytest

from gradewell.llm import common, queries
from tests.conftest import SF_SMALL

PYTHON = r"EvalPython|PythonUDF|MapInPandas|MapInArrow|InPandas|NestedLoopJoin|CartesianProduct"


@pytest.mark.parametrize("name", ["op7_line_dedup", "op10_exact_dedup"])
def test_native_plans(spark, monkeypatch, name):
    plans, store = [], common.store

    def seen(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, purpose)

    for module in (queries.line_chunks, queries.bloom_dedup):
        if hasattr(module, "store"):
            monkeypatch.setattr(module, "store", seen)
    plans.append(queries.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString())
    assert not any(re.search(PYTHON, plan) for plan in plans)
