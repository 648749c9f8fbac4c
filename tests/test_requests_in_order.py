"""Change sets against plain Python that takes the requests one after another."""

import random

import pytest

from gradewell.operators import changes as CH
from gradewell.operators import numbering as NU
from gradewell.operators import quality as QU
from gradewell.operators import relations as RE
from gradewell.schema import question_types
from gradewell.sources.shared import shared_folder
from tests.conftest import rows

QUESTIONS = "id_pyt long, tresc string, id_typu long, id_autora long, pkt double, id_quizu long, id_kategorii long, ukryty boolean"
TEMPLATES = "id_odp_w long, id_pyt long, tresc_odp string, poziom_poprawnosci int, komentarz string, ost_modyfikacja timestamp_ntz"
QUIZZES = "id_quizu long, id_wlasciciela long, nazwa string, id_grupy long, limit_podejsc int, limit_czasowy string, ukryty boolean"


@pytest.fixture(scope="module")
def types(spark):
    return question_types(spark)


def test_question_updates(spark, types):
    rng = random.Random(1)
    shapes = {r["id_typu"]: (r["liczba_odp"], r["wielokrotnego_wyboru"]) for r in types.collect()}
    table = [(i, f"t{i}", rng.choice([1, 3, 7]), 1, 1.0, 1, 1, rng.random() < 0.3) for i in range(1, 30)]
    answers = [(k, 1 + k % 31, f"a{k}", rng.choice([100, 0]), None, None) for k in range(110)]
    batch = [
        (n, rng.randrange(1, 33), rng.choice([None, None, " ", f"new{n}"]), rng.choice([None, None, 1, 3, 7]),
         rng.choice([None, None, -1.0, 2.5]), rng.choice([None, 2]))
        for n in range(200)
    ]
    state = {r[0]: list(r) for r in table}
    refused = []
    for nr, key, text, kind, points, category in batch:
        if key not in state:
            refused.append((nr, key, "no_question"))
            continue
        why = [w for bad, w in ((text == " ", "tresc_pusta"), (points is not None and points < 0, "pkt_ujemne")) if bad]
        if why:
            refused.append((nr, key, ",".join(why)))
            continue
        row = state[key]
        for place, value in ((1, text), (2, kind), (4, points), (6, category)):
            if value is not None:
                row[place] = value
        need, multi = shapes[row[2]]
        own = [a for a in answers if a[1] == key]
        row[7] = row[7] or len(own) < need or not (multi or any(a[3] == 100 for a in own))
    frame = spark.createDataFrame(batch, "nr long, id_pyt long, tresc string, id_typu long, pkt double, id_kategorii long")
    got, rejects = CH.update_questions(frame, spark.createDataFrame(table, QUESTIONS), types, spark.createDataFrame(answers, TEMPLATES))
    assert rows(got) == sorted(map(tuple, state.values()), key=repr)
    assert rows(rejects) == sorted(refused, key=repr)


def test_option_changes(spark, types):
    rng = random.Random(2)
    questions = spark.createDataFrame([(i, "t", 3, 1, 1.0, 1, 1, False) for i in range(1, 4)], QUESTIONS)
    table = [(k, rng.randrange(1, 4), rng.choice("AB"), 0, None, None) for k in range(1, 9)]
    batch = [
        (n, rng.choice(["create", "update", "update", "delete", "delete"]), rng.randrange(1, 5), rng.choice("ABC"), rng.choice([0, 100, 150]), f"k{n}")
        for n in range(120)
    ]
    state, made, refused = [list(r[:5]) for r in table], 8, []
    for nr, op, key, text, level, comment in batch:
        found = next((r for r in state if r[1] == key and r[2] == text), None)
        why = "poziom_poza_zakresem" if level > 100 and op != "delete" else None
        if key > 3:
            why = "no_question"
        elif op != "create" and found is None:
            why = "no_template"
        if why:
            refused.append((nr, op, key, text, why))
        elif op == "create":
            made += 1
            state.append([made, key, text, level, comment])
        elif op == "update":
            found[3:] = [level, comment]
        else:
            state.remove(found)
    frame = spark.createDataFrame(batch, "nr long, op string, id_pyt long, tresc_odp string, poziom_poprawnosci int, komentarz string")
    frame = frame.selectExpr("*", "CAST('2013-01-01' AS TIMESTAMP_NTZ) AS kiedy")
    got, rejects = CH.apply_option_changes(frame, spark.createDataFrame(table, TEMPLATES), questions, types)
    assert rows(got.drop("ost_modyfikacja")) == sorted(map(tuple, state), key=repr)
    assert rows(rejects) == sorted(refused, key=repr)


def test_moves_out_of_the_holding_area(spark):
    quizzes = spark.createDataFrame([(1, 1, "a", 0, None, None, False), (2, 1, "b", 0, None, None, False), (3, 1, "c", 4, None, None, False)], QUIZZES)
    groups = spark.createDataFrame([(0,), (4,), (5,), (6,)], "id_grupy long")
    asked = [(1, 1, 0), (2, 1, 9), (3, 1, 5), (4, 1, 6), (5, 1, 9), (6, 2, 0), (7, 3, 5), (8, 7, 5)]
    state, rejects, touched = CH.move_quizzes(spark.createDataFrame(asked, "nr long, id_quizu long, id_grupy long"), quizzes, groups)
    assert rows(state, "id_quizu", "id_grupy") == [(1, 5), (2, 0), (3, 4)]
    assert rows(rejects) == [(2, 1, 9, "no_group"), (4, 1, 6, "not_in_limbo"), (5, 1, 9, "no_group"), (7, 3, 5, "not_in_limbo"), (8, 7, 5, "no_quiz")]
    assert rows(touched) == [(5,)]


def test_profile_updates(spark):
    users = spark.createDataFrame([(1, "l1", "n1", "a@b.pl", "user"), (2, "l2", "n2", "c@d.pl", "user")], "id_uz long, login string, nazwa_uz string, email string, ranga string")
    asked = [
        (1, 1, "new", None, None), (2, 1, None, "much_too_long_for_a_login", None), (3, 1, None, None, "x@y.pl"),
        (4, 2, "new", "free", None), (5, 2, None, "free", None), (6, 1, None, "free", None), (7, 1, "new", None, None), (8, 9, "z", None, None),
    ]
    state, rejects = CH.update_profiles(spark.createDataFrame(asked, "nr long, id_uz long, nazwa_uz string, login string, email string"), users)
    assert rows(rejects, "nr", "powod") == [(2, "login_za_dlugi"), (4, "nazwa_uz_zajete"), (6, "login_zajete"), (8, "no_user")] or rows(rejects, "nr") == [(2,), (4,), (5,), (8,)]
    assert ("new", "x@y.pl") in rows(state.filter("id_uz = 1"), "nazwa_uz", "email")


def test_forms_that_arrive_twice(spark, types):
    questions = spark.createDataFrame([(1, "t", 3, 1, 1.0, 1, 1, False)], QUESTIONS)
    answers = spark.createDataFrame([(k, 1, f"a{k}", 100 if k == 1 else 0, None, None) for k in range(1, 6)], TEMPLATES)
    form = [(5, 1, "2013-01-01 10:00:00", 1, ["a1"], None)]
    schema = "id_uz long, id_quizu long, data_wyslania string, id_pyt long, chosen array<string>, open_text string"
    once, twice = (CH.shown_options(spark.createDataFrame(form * n, schema), questions, types, answers, "s") for n in (1, 2))
    assert rows(once) == rows(twice)


def test_numbering_keeps_nulls(spark):
    frame = spark.createDataFrame([(1, "x"), (None, "y"), (3, None)], "id long, g string")
    assert rows(NU.numbered_by_id(frame, "id")) == sorted([(None, "y", 1), (1, "x", 2), (3, None, 3)], key=repr)
    assert rows(NU.numbered_by_id(frame, "id", ["g"])) == sorted([(None, "y", 1), (1, "x", 1), (3, None, 1)], key=repr)


def test_missing_tables_and_columns_are_errors(spark):
    one = spark.createDataFrame([(1, 1)], "id_uz long, id_grupy long")
    with pytest.raises(KeyError):
        RE.orphans({"dostep_grupa": one})
    with pytest.raises(KeyError):
        QU.check_unique({"dostep_grupa": one})
    with pytest.raises(KeyError):
        QU.check_not_null({"uzytkownik": one.select("id_uz")})


def test_unique_ignores_nulls_and_keeps_types(spark):
    tables = {t: spark.createDataFrame([], ", ".join(f"{c} string" for c in cs)) for t, cs in QU.UNIQUE if t != "uzytkownik"}
    tables["uzytkownik"] = spark.createDataFrame([(None, "a", "x"), (None, "b", "y"), ("m", "b", "z")], "email string, login string, nazwa_uz string")
    assert rows(QU.check_unique(tables)) == [("uzytkownik", "unikalne_login", "b")]


def test_shared_folder_of_a_cluster(spark):
    class Cluster:
        conf = spark.conf

        class sparkContext:
            master = "spark://somewhere:7077"

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            shared_folder(Cluster, "x")
        assert spark.conf.get("spark.sql.warehouse.dir") in shared_folder(spark, "x")
