"""Forms that may be handed in, and those that may not."""

import datetime

from gradewell.operators import changes as CH
from tests.conftest import rows

AT = datetime.datetime(2020, 5, 1, 12)
QUIZZES = [(1, 1, False), (2, 1, True), (3, 2, False), (4, None, False)]
GROUPS = [(1, False), (2, True), (3, None)]
ACCESS = [(2, 20, "11"), (1, 20, "10"), (1, 20, "10")]


def gated(spark, forms, schema="id_uz long, id_grupy long, id_quizu long, data_wyslania timestamp_ntz"):
    return CH.gate_submissions(
        spark.createDataFrame(forms, schema),
        spark.createDataFrame(QUIZZES, "id_quizu long, id_grupy long, ukryty boolean"),
        spark.createDataFrame(GROUPS, "id_grupy long, na_zaproszenie boolean"),
        spark.createDataFrame(ACCESS, "id_grupy long, id_uz long, prawa_dost string"),
        "01",
    )


def test_first_broken_rule_is_the_reason(spark):
    forms = [
        (10, 1, 1, AT), (10, 1, 1, AT), (10, None, 1, AT),  # one form, three times
        (20, 2, 3, AT), (10, 2, 3, AT), (10, 9, 1, AT), (11, 1, 3, AT), (11, 1, 2, AT), (11, 1, 7, AT),
        (12, None, 7, AT), (12, None, 4, AT), (None, 1, 1, AT), (13, 1, None, AT), (14, 3, 1, AT),
    ]
    accepted, refused, members = gated(spark, forms)
    assert rows(accepted.distinct(), "id_uz", "id_quizu") == [(10, 1), (20, 3)]
    assert rows(refused, "id_uz", "id_grupy", "id_quizu", "powod") == sorted(
        [
            (10, 2, 3, "invite_only"), (10, 9, 1, "no_group"), (11, 1, 3, "wrong_group"), (11, 1, 2, "hidden"),
            (11, 1, 7, "no_quiz"), (12, None, 7, "no_quiz"), (12, None, 4, "no_group"), (None, 1, 1, "no_user"),
            (13, 1, None, "no_quiz"), (14, 3, 1, "wrong_group"),
        ],
        key=repr,
    )
    # who enters an open group becomes a member, whatever becomes of the form
    fresh = [(1, 10, "01"), (1, 11, "01"), (1, 13, "01"), (3, 14, "01")]
    assert rows(members) == sorted([*ACCESS, *fresh], key=repr)


def test_group_of_the_quiz_where_none_is_named(spark):
    accepted, refused, _ = gated(spark, [(10, 1, AT), (10, 3, AT)], "id_uz long, id_quizu long, data_wyslania timestamp_ntz")
    assert rows(accepted, "id_uz", "id_grupy", "id_quizu") == [(10, 1, 1)]
    assert rows(refused, "id_grupy", "powod") == [(2, "invite_only")]


def test_no_forms(spark):
    assert [df.count() for df in gated(spark, [])] == [0, 0, len(ACCESS)]


def test_every_form_delivered_twice(spark, domain):
    tables = (domain.quiz, domain.grupa_quizowa, domain.dostep_grupa)
    kinds = (domain.pytanie, domain.typ, domain.odpowiedz_wzorcowa)
    once, twice = domain.submissions, domain.submissions.union(domain.submissions)
    answers = []
    for forms in (once, twice):
        shown = CH.shown_options(forms, *kinds, "s", CH.gate_submissions(forms, *tables)[0])
        answers.append(rows(CH.expand_submissions(shown)[0]))
    assert answers[0] == answers[1]
    assert rows(CH.refused_entries(once, kinds[0])) == rows(CH.refused_entries(twice, kinds[0]))


def test_refused_entries(spark):
    entries = spark.createDataFrame(
        [(1, 1, AT, 5), (1, 1, AT, 6), (1, 1, AT, 7), (1, 1, AT, 8), (1, 1, AT, None), (1, 1, AT, 8)],
        "id_uz long, id_quizu long, data_wyslania timestamp_ntz, id_pyt long",
    )
    questions = spark.createDataFrame([(5, 1, False), (6, 2, False), (7, 1, True)], "id_pyt long, id_quizu long, ukryty boolean")
    assert rows(CH.refused_entries(entries, questions), "id_pyt", "powod") == [
        (6, "other_quiz"), (7, "hidden_question"), (8, "no_question"),
    ]
