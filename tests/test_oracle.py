"""Every registered query against its SQL in DuckDB, on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from checks import oracle_queries
from checks.compare import compare, database
from gradewell.plans import registry
from tests.conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return database(SF_SMALL)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, db, name):
    assert compare(spark, db, SF_SMALL, name) is None


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracle_queries.oracle_sql())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["id_grupy", "place", "id_uz", "nazwa_uz", "pkt"]
    assert df.limit(1).count() == 1
