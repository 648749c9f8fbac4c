import pytest
from pyspark.sql import functions as F

from gradewell.operators import changes as CH
from gradewell.operators import quality as QU
from gradewell.schema import question_types
from tests.conftest import rows


@pytest.fixture(scope="module")
def types(spark):
    return question_types(spark)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(
        [(1, "a", 1, 1, 1.0, 1, 1, False), (2, "b", 1, 1, 1.0, 1, 1, True), (3, "c", 4, 1, 1.0, 2, 1, False),
         (4, "d", 4, 1, 1.0, 2, 1, True)],
        "id_pyt long, tresc string, id_typu long, id_autora long, pkt double, id_quizu long, id_kategorii long, "
        "ukryty boolean",
    )


@pytest.fixture(scope="module")
def templates(spark):
    return spark.createDataFrame(
        [(1, 1, "t", 100, None, None), (2, 1, "f", 0, None, None), (3, 2, "t", 100, None, None),
         (4, 2, "t", 0, None, None), (5, 3, "t", 100, None, None), (6, 4, "", 100, None, None)],
        "id_odp_w long, id_pyt long, tresc_odp string, poziom_poprawnosci int, komentarz string, "
        "ost_modyfikacja timestamp_ntz",
    )


@pytest.fixture(scope="module")
def quizzes(spark):
    return spark.createDataFrame(
        [(1, 3, "q1", 0, None, None, False), (2, 4, "q2", 5, 3, "10 minutes", False), (3, 3, "q3", 5, None, None, True)],
        "id_quizu long, id_wlasciciela long, nazwa string, id_grupy long, limit_podejsc int, limit_czasowy string, "
        "ukryty boolean",
    ).withColumn("data_utworzenia", F.lit("2013-01-01").cast("timestamp_ntz"))


def test_toggle_counts_every_request(spark, questions, types, templates):
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (3,), (4,), (9,)], "id_pyt long")
    state, rejects = CH.toggle_questions(asked, questions, types, templates)
    # 1: hidden and shown again; 2: shown; 3: invalid, can only be hidden; 4: invalid, stays hidden
    assert rows(state, "id_pyt", "ukryty") == [(1, False), (2, False), (3, True), (4, True)]
    assert rows(rejects) == [(3, "invalid", 2), (4, "invalid", 1), (9, "no_question", 1)]


def test_last_change_wins_and_rerun_changes_nothing(spark, quizzes):
    asked = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 3, False), (4, 9, True)], "nr long, id_quizu long, ukryty boolean")
    state, rejects = CH.set_quiz_visibility(asked, quizzes)
    assert rows(state, "id_quizu", "ukryty") == [(1, False), (2, False), (3, False)]
    assert rows(rejects) == [(4, 9, "no_quiz")]
    assert rows(CH.set_quiz_visibility(asked, state)[0]) == rows(state)


def test_update_hides_invalid_and_refuses_broken(spark, questions, types, templates):
    asked = spark.createDataFrame(
        [(1, 1, "nowe", 4, None, None), (2, 2, None, None, -1.0, None), (3, 3, "", None, None, None), (4, 9, "x", None, None, None)],
        "nr long, id_pyt long, tresc string, id_typu long, pkt double, id_kategorii long",
    )
    state, rejects = CH.update_questions(asked, questions, types, templates)
    got = {r.id_pyt: (r.tresc, r.id_typu, r.ukryty) for r in state.collect()}
    assert got == {1: ("nowe", 4, True), 2: ("b", 1, True), 3: ("c", 4, False), 4: ("d", 4, True)}
    assert rows(rejects) == [(2, 2, "pkt_ujemne"), (3, 3, "tresc_pusta"), (4, 9, "no_question")]


def test_option_changes(spark, questions, types, templates):
    asked = spark.createDataFrame(
        [(1, "create", 1, "new", 0, None), (2, "create", 1, " ", 0, None), (3, "update", 2, "t", 40, "k"),
         (4, "delete", 1, "f", None, None), (5, "delete", 1, "gone", None, None), (6, "create", 9, "x", 0, None),
         (7, "update", 3, "t", 101, None), (8, "create", 3, "late", 100, None)],
        "nr long, op string, id_pyt long, tresc_odp string, poziom_poprawnosci int, komentarz string",
    ).withColumn("kiedy", F.lit("2020-02-02").cast("timestamp_ntz"))
    state, rejects = CH.apply_option_changes(asked, templates, questions, types)
    got = {r.id_odp_w: (r.id_pyt, r.tresc_odp, r.poziom_poprawnosci, r.komentarz, r.ost_modyfikacja is not None) for r in state.collect()}
    assert got == {
        1: (1, "t", 100, None, False), 3: (2, "t", 40, "k", True), 4: (2, "t", 0, None, False),
        5: (3, "t", 100, None, False), 6: (4, "", 100, None, False), 7: (1, "new", 0, None, True),
        8: (3, "late", 100, None, True),
    }
    assert rows(rejects, "nr", "powod") == [
        (2, "tresc_odp_pusta"), (5, "no_template"), (6, "no_question"), (7, "poziom_poza_zakresem"),
    ]


def test_moves_only_from_limbo(spark, quizzes):
    groups = spark.createDataFrame([(0,), (5,)], "id_grupy long")
    asked = spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 1, 77), (4, 9, 5)], "nr long, id_quizu long, id_grupy long")
    state, rejects, touched = CH.move_quizzes(asked, quizzes, groups)
    assert rows(state, "id_quizu", "id_grupy") == [(1, 5), (2, 5), (3, 5)]
    assert rows(rejects, "nr", "powod") == [(2, "not_in_limbo"), (3, "no_group"), (4, "no_quiz")]
    assert rows(touched) == [(5,)]


def test_new_groups_compete_for_names(spark):
    users = spark.createDataFrame([(1, "teacher"), (2, "user"), (3, "moderator")], "id_uz long, ranga string")
    groups = spark.createDataFrame([(0, 0, "LIMBO", False, None), (4, 1, "stara", False, None)], "id_grupy long, id_wlasciciela long, nazwa string, na_zaproszenie boolean, haslo string")
    asked = spark.createDataFrame(
        [(1, 2, "nowa", None, None), (2, 1, "nowa", None, None), (3, 3, "nowa", True, None), (4, 3, "stara", True, None),
         (5, 3, "inna", True, None), (6, 3, None, True, None)],
        "nr long, id_wlasciciela long, nazwa string, na_zaproszenie boolean, haslo string",
    )
    state, rejects = CH.create_groups(asked, groups, users)
    assert rows(state.filter("id_grupy > 4"), "id_grupy", "nazwa", "na_zaproszenie") == [(5, "nowa", False), (6, "inna", True)]
    assert rows(rejects, "nr", "powod") == [(1, "no_privilege"), (3, "name_taken"), (4, "name_taken"), (6, "nazwa_pusta")]


def test_profile_values_must_stay_unique(spark):
    users = spark.createDataFrame([(i, f"l{i}", f"n{i}", f"u{i}@ex.pl") for i in range(1, 6)], "id_uz long, login string, nazwa_uz string, email string")
    asked = spark.createDataFrame(
        [(1, 1, "n1", None, None), (2, 2, "n3", None, None), (3, 3, None, "nowy", None), (4, 4, None, "nowy", None),
         (5, 5, None, None, "zly"), (6, 99, None, None, None)],
        "nr long, id_uz long, nazwa_uz string, login string, email string",
    )
    state, rejects = CH.update_profiles(asked, users)
    assert rows(state, "id_uz", "login") == [(1, "l1"), (2, "l2"), (3, "nowy"), (4, "l4"), (5, "l5")]
    assert rows(rejects) == [
        (2, 2, "nazwa_uz_zajete"), (4, 4, "login_zajete"), (5, 5, "email_format"), (6, 99, "no_user"),
    ]


def test_deleted_owner_leaves_quizzes_in_limbo(spark, quizzes):
    users = spark.createDataFrame([(0,), (3,), (4,)], "id_uz long")
    access = spark.createDataFrame([(5, 3, "1"), (5, 4, "1")], "id_grupy long, id_uz long, prawa_dost string")
    gone = spark.createDataFrame([(3,), (0,)], "id_uz long")
    tables = {
        "uzytkownik": users, "quiz": quizzes, "dostep_grupa": access,
        "grupa_quizowa": spark.createDataFrame([(5, 3), (6, 4)], "id_grupy long, id_wlasciciela long"),
        "pytanie": spark.createDataFrame([(1, 3), (2, 4), (3, None)], "id_pyt long, id_autora long"),
        "ranking": spark.createDataFrame([(3, 5), (4, 5)], "id_uz long, id_grupy long"),
        "odpowiedz_uzytkownika": spark.createDataFrame([(3, 1), (4, 1), (4, 1)], "id_uz long, id_pyt long"),
        "dyskusja": spark.createDataFrame([(2, 3), (2, 4)], "id_quizu long, id_uz long"),
    }
    got = CH.delete_users(gone, tables)
    left = {r.id_uz for r in got["uzytkownik"].collect()}
    keys = {"quiz": "id_wlasciciela", "grupa_quizowa": "id_wlasciciela", "pytanie": "id_autora"}
    for name, table in got.items():
        pointed = {r[0] for r in table.select(keys.get(name, "id_uz")).collect()} - {None}
        assert pointed <= left, name
    assert rows(got["grupa_quizowa"]) == [(5, 0), (6, 4)]
    assert rows(got["pytanie"]) == [(1, 0), (2, 4), (3, None)]
    assert rows(got["odpowiedz_uzytkownika"]) == [(4, 1), (4, 1)]
    assert rows(got["uzytkownik"]) == [(0,), (4,)]
    assert rows(got["quiz"], "id_quizu", "id_wlasciciela", "id_grupy") == [(1, 0, 0), (2, 4, 5), (3, 0, 0)]
    assert rows(got["dostep_grupa"]) == [(5, 4, "1")]


def test_new_ids_follow_the_highest(spark, quizzes, questions, types):
    asked = spark.createDataFrame([(10, 3, "x", None), (2, 4, "y", 5)], "nr long, id_wlasciciela long, nazwa string, id_grupy long")
    state = CH.create_quizzes(asked, quizzes, F.lit("2020-01-01").cast("timestamp_ntz"))
    assert rows(state.filter("id_quizu > 3"), "id_quizu", "nazwa", "id_grupy") == [(4, "y", 5), (5, "x", 1)]
    categories = spark.createDataFrame([(3, "k"), (2, "l")], "id_kategorii long, nazwa string")
    fresh = CH.create_questions(
        spark.createDataFrame([(1, 1, 9)], "nr long, id_quizu long, id_autora long"),
        questions, types, categories, F.lit("2020-01-01 10:00:00").cast("timestamp_ntz"),
    ).filter("id_pyt > 4")
    assert rows(fresh, "id_pyt", "tresc", "id_typu", "id_kategorii", "ukryty", "pkt") == [
        (5, "Nowe pytanie z 2020-01-01 10:00:00", 1, 2, True, 1.0)
    ]


def test_quality_reports_seed_edges(spark, questions, types, templates):
    found = rows(QU.check_templates(templates, questions, types))
    assert found == [("odpowiedz_wzorcowa", "tresc_odp_pusta", "6")]
    multi = questions.withColumn("id_typu", F.lit(7).cast("bigint"))
    partial = templates.withColumn("poziom_poprawnosci", F.lit(40))
    assert {r[1] for r in rows(QU.check_templates(partial, multi, types))} == {"poziom_wielokrotny", "tresc_odp_pusta"}
    nulls = QU.check_not_null({"pytanie": questions.withColumn("tresc", F.lit(None).cast("string"))})
    assert rows(nulls) == [("pytanie", "nie_null", "tresc", 4)]
    category = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id_kategorii long, nazwa string")
    none = {}
    for table, columns in QU.UNIQUE:
        none[table] = spark.createDataFrame([], ", ".join({f"{c} string" for t, cs in QU.UNIQUE if t == table for c in cs}))
    assert rows(QU.check_unique(none | {"kategoria": category})) == [("kategoria", "unikalne_nazwa", "a")]
    with pytest.raises(KeyError):
        QU.check_unique({"kategoria": category})
