import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def domain(spark, tmp_path_factory):
    """The smallest test tables, stored once as domain tables."""
    from gradewell.sources.testrequests import Requests

    names = [
        "uzytkownik", "grupa_quizowa", "quiz", "pytanie", "odpowiedz_wzorcowa", "dostep_grupa",
        "odpowiedz_uzytkownika", "submissions", "ranking",
    ]
    return Requests(spark, SF_SMALL).stored(str(tmp_path_factory.mktemp("domain")), *names)


def rows(df, *columns):
    """Rows as sorted tuples, for comparing."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
