"""Deletes along the foreign keys, begun at every table."""

import pytest
from pyspark.sql import functions as F

from gradewell.operators import cascade as CC
from gradewell.operators.relations import FOREIGN_KEYS, orphans
from gradewell.schema import LIMBO_GROUP, LIMBO_USER, question_types
from gradewell.sources.testrequests import Requests
from tests.conftest import SF_SMALL, rows

NAMES = sorted({t for c, _, p, _ in FOREIGN_KEYS for t in (c, p)})


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return Requests(spark, SF_SMALL).stored(str(tmp_path_factory.mktemp("cascade")), *NAMES).tables(*NAMES)


@pytest.mark.parametrize("table", sorted(CC.PRIMARY_KEYS))
def test_no_new_orphans(tables, table):
    key = CC.PRIMARY_KEYS[table]
    start = {table: tables[table].filter(F.col(key) % 3 < 2).select(key)}
    after = {**tables, **CC.cascade(start, tables)}
    kept = {r[0] for r in after[table].select(key).collect()}
    gone = {r[0] for r in start[table].collect()} - {CC.KEPT.get(table)}
    assert kept == {r[0] for r in tables[table].select(key).collect()} - gone
    if table not in CC.KEPT:
        assert orphans(after).exceptAll(orphans(tables)).isEmpty()
    else:  # what passes on goes to the row that stays, where there is one
        assert orphans(after).join(orphans(tables), ["tabela", "klucz", "wartosc"], "left_anti").filter(f"wartosc <> {CC.KEPT[table]}").isEmpty()
    assert all(after[name].columns == tables[name].columns for name in NAMES)


def test_several_tables_at_once_and_other_policies(spark):
    frames = {
        "grupa_quizowa": spark.createDataFrame([(0, 0), (1, 5), (2, 6)], "id_grupy long, id_wlasciciela long"),
        "quiz": spark.createDataFrame([(10, 5, 1), (11, 6, 2), (12, 6, 1)], "id_quizu long, id_wlasciciela long, id_grupy long"),
        "pytanie": spark.createDataFrame([(100, 10, 6), (110, 11, 5), (120, 12, 5)], "id_pyt long, id_quizu long, id_autora long"),
        "odpowiedz_wzorcowa": spark.createDataFrame([(1, 100), (2, 110), (3, 120)], "id_odp_w long, id_pyt long"),
        "odpowiedz_uzytkownika": spark.createDataFrame([(1, 100, 5), (2, 110, 6), (3, 120, 6)], "id_odp_u long, id_pyt long, id_uz long"),
        "uzytkownik": spark.createDataFrame([(0,), (5,), (6,)], "id_uz long"),
        **{name: spark.createDataFrame([(1, 5), (2, 6)], "id_grupy long, id_uz long") for name in ("dostep_grupa", "ranking")},
        "dyskusja": spark.createDataFrame([(10, 6), (11, 5), (12, 6)], "id_quizu long, id_uz long"),
    }
    ids = lambda name, *keys: {name: spark.createDataFrame([(k,) for k in keys], f"{CC.PRIMARY_KEYS[name]} long")}
    got = CC.cascade({**ids("uzytkownik", 0, 5, 99), **ids("grupa_quizowa", 0, 2)}, frames)
    assert rows(got["uzytkownik"]) == [(0,), (6,)] and rows(got["grupa_quizowa"]) == [(0, 0), (1, 0)]
    assert rows(got["quiz"]) == [(10, LIMBO_USER, LIMBO_GROUP), (11, 6, LIMBO_GROUP), (12, 6, 1)]
    assert rows(got["pytanie"], "id_pyt", "id_autora") == [(100, 6), (110, 0), (120, 0)]
    assert rows(got["ranking"]) == [] and rows(got["dyskusja"]) == [(10, 6), (12, 6)]
    assert rows(got["odpowiedz_uzytkownika"], "id_odp_u") == [(2,), (3,)] and "odpowiedz_wzorcowa" not in got
    # a group takes its quizzes along, and they all that is below them
    policies = {k: v for k, v in CC.POLICIES.items() if k != ("quiz", "id_grupy")}
    got = CC.cascade(ids("grupa_quizowa", 1), frames, policies)
    assert rows(got["quiz"], "id_quizu") == [(11,)] == rows(got["dyskusja"], "id_quizu")
    assert rows(got["odpowiedz_wzorcowa"]) == [(2, 110)] and rows(got["odpowiedz_uzytkownika"], "id_odp_u") == [(2,)]
    with pytest.raises(KeyError):
        CC.cascade(ids("quiz", 10), {"quiz": frames["quiz"]})
    assert question_types(spark).columns[0] == CC.PRIMARY_KEYS["typ"]
