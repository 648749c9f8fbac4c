import pytest
from pyspark.sql import functions as F

from gradewell.operators import changes, scoring
from gradewell.schema import question_types
from tests.conftest import rows

T0 = "2013-09-09 22:10:12.345"


@pytest.fixture(scope="module")
def types(spark):
    return question_types(spark)


@pytest.fixture(scope="module")
def templates(spark):
    data = [
        # single choice of four
        (1, 1, "A", 100), (2, 1, "B", 0), (3, 1, "C", 0), (4, 1, "D", 0),
        # three wanted, four templates
        (5, 2, "AA", 0), (6, 2, "BB", 100), (7, 2, "CC", 0), (8, 2, "DD", 0),
        # open question with partial credit
        (9, 3, "abc", 100), (10, 3, "cde", 0), (11, 3, "efg", 0), (12, 3, "ghi", 40),
        # multi-choice
        (13, 4, "x", 100), (14, 4, "y", 0), (15, 4, "z", 100),
        # multi-choice without a right option
        (16, 5, "x", 0), (17, 5, "y", 0), (18, 5, "z", 0),
        # the same text twice with different levels
        (19, 6, "dup", 100), (20, 6, "dup", 0), (21, 6, "other", 0),
        # one template where the type asks for five
        (22, 7, "only", 100),
        # an empty template text
        (23, 8, "", 100), (24, 8, "q", 0),
    ]
    return spark.createDataFrame(
        [(w, p, t, level, f"k{w}" if w in (1, 2, 9, 13) else None, None) for w, p, t, level in data],
        "id_odp_w long, id_pyt long, tresc_odp string, poziom_poprawnosci int, komentarz string, "
        "ost_modyfikacja timestamp_ntz",
    )


@pytest.fixture(scope="module")
def questions(spark):
    kinds = {1: 3, 2: 2, 3: 11, 4: 7, 5: 7, 6: 1, 7: 4, 8: 1, 9: 2}
    return spark.createDataFrame(
        [(p, f"p{p}", t, 1, 2.0, 1, 1, False) for p, t in kinds.items()],
        "id_pyt long, tresc string, id_typu long, id_autora long, pkt double, id_quizu long, id_kategorii long, "
        "ukryty boolean",
    )


def answered(spark, *data):
    return spark.createDataFrame(
        [(u, p, t, z) for u, p, t, z in data], "id_uz long, id_pyt long, tresc_odp string, zaznaczona boolean"
    ).withColumn("data_wyslania", F.lit(T0).cast("timestamp_ntz"))


def score(spark, questions, types, templates, *data, **options):
    df = scoring.question_scores(answered(spark, *data), questions, types, templates, **options)
    return {(r.id_uz, r.id_pyt): r.zdobyte_pkt for r in df.collect()}


def test_single_choice(spark, questions, types, templates):
    got = score(
        spark, questions, types, templates,
        (1, 1, "A", True), (1, 1, "B", False),
        (2, 1, "A", True), (2, 1, "B", True),
        (3, 1, "A", False), (3, 1, "B", False),
        (4, 1, "A", False), (4, 1, "B", True),
    )
    assert got == {(1, 1): 2.0, (2, 1): 0.0, (3, 1): 0.0, (4, 1): 0.0}


def test_multi_choice_is_all_or_nothing(spark, questions, types, templates):
    def ticks(user, question, *ticked):
        return [(user, question, t, t in ticked) for t in "xyz"]

    got = score(
        spark, questions, types, templates,
        *ticks(1, 4, "x", "z"), *ticks(2, 4, "x"), *ticks(3, 4, "x", "y", "z"), *ticks(4, 4),
        *ticks(1, 5), *ticks(2, 5, "y"),
    )
    assert got == {(1, 4): 2.0, (2, 4): 0.0, (3, 4): 0.0, (4, 4): 0.0, (1, 5): 2.0, (2, 5): 0.0}


def test_open_question_partial_credit(spark, questions, types, templates):
    got = score(
        spark, questions, types, templates,
        (1, 3, "abc", True), (2, 3, "ghi", True), (3, 3, "cde", True), (4, 3, "nil", True), (5, 3, " ABC ", True),
    )
    assert got == {(1, 3): 2.0, (2, 3): 0.8, (3, 3): 0.0, (4, 3): 0.0, (5, 3): 0.0}
    loose = score(spark, questions, types, templates, (5, 3, " ABC ", True), normalize=True)
    assert loose == {(5, 3): 2.0}


def test_doubled_template_text_counts_once(spark, questions, types, templates):
    got = score(spark, questions, types, templates, (1, 6, "dup", True), (1, 6, "other", False))
    assert got == {(1, 6): 2.0}


def test_attempt_sums_distinct_questions(spark, questions, types, templates):
    answers = answered(spark, (1, 1, "A", True), (1, 1, "B", False), (1, 3, "ghi", True))
    scores = scoring.question_scores(answers, questions, types, templates)
    (attempt,) = scoring.attempt_history(scores).collect()
    assert (attempt.zdobyte_pkt, attempt.max_pkt) == (2.8, 4.0)
    assert (attempt.zdobyte_calk, attempt.max_calk, attempt.ocena) == (2, 4, "mediocre-score")


def test_score_never_leaves_its_range(domain):
    scores = scoring.question_scores(
        domain.odpowiedz_uzytkownika, domain.pytanie, domain.typ, domain.odpowiedz_wzorcowa
    )
    assert scores.filter("zdobyte_pkt < 0 OR zdobyte_pkt > max_pkt").count() == 0


def submitted(spark, *data):
    return spark.createDataFrame(
        [(u, 1, p, c, o) for u, p, c, o in data],
        "id_uz long, id_quizu long, id_pyt long, chosen array<string>, open_text string",
    ).withColumn("data_wyslania", F.lit(T0).cast("timestamp_ntz"))


def test_submission_rows(spark, questions, types, templates):
    forms = submitted(spark, (1, 1, ["A"], None), (1, 3, None, "ghi"), (2, None, None, None))
    shown = changes.shown_options(forms, questions, types, templates, "s")
    answers, failed = changes.expand_submissions(shown)
    per_question = {(r.id_uz, r.id_pyt): r["n"] for r in answers.groupBy("id_uz", "id_pyt").agg(F.count("*").alias("n")).collect()}
    # questions 5 (no right option) and 9 (no templates) cannot be shown; open question 3 is one row
    assert per_question == {
        (u, p): n for u in (1, 2) for p, n in {1: 4, 2: 3, 3: 1, 4: 3, 6: 2, 7: 1, 8: 2}.items()
    }
    assert rows(failed, "id_uz", "id_pyt") == [(1, 5), (1, 9), (2, 5), (2, 9)]
    ticked = answers.filter("zaznaczona")
    assert rows(ticked.filter("id_uz = 1"), "id_pyt", "tresc_odp") == [(1, "A"), (3, "ghi")]
    assert rows(ticked.filter("id_uz = 2"), "id_pyt", "tresc_odp") == [(3, "nil")]


def test_draw_has_a_right_option_and_repeats(spark, questions, types, templates):
    draws = spark.range(40).select(F.col("id").alias("id_uz")).withColumn("id_pyt", F.explode(F.array(*map(F.lit, [1, 2, 7, 8]))))
    from gradewell.operators.sampling import sample_options

    first, failed = sample_options(draws, questions, types, templates, "s")
    again, _ = sample_options(draws, questions, types, templates, "s")
    other, _ = sample_options(draws, questions, types, templates, "t")
    assert rows(first) == rows(again)
    assert rows(first) != rows(other)
    assert failed.count() == 0
    checked = first.groupBy("id_uz", "id_pyt").agg(
        F.count("*").alias("n"), F.max("poziom_poprawnosci").alias("best"), F.countDistinct("id_odp_w").alias("d"),
        F.min("place").alias("lo"), F.max("place").alias("hi"),
    )
    want = {1: 4, 2: 3, 7: 1, 8: 2}
    for r in checked.collect():
        assert (r.n, r.best, r.d, r.lo, r.hi) == (want[r.id_pyt], 100, want[r.id_pyt], 1, want[r.id_pyt])


def test_comments_of_ticked_options(spark, questions, types, templates):
    forms = submitted(spark, (1, 1, ["A", "B"], None), (1, 3, None, "xx abc xx"), (1, 4, ["y"], None))
    shown = changes.shown_options(forms, questions, types, templates, "s")
    got = {r.id_pyt: r.komentarz for r in scoring.submission_comments(shown).collect()}
    assert got[1] in ("Komentarz: k1k2", "Komentarz: k2k1")
    # the drawn template of an open question counts when its text is inside the entered one
    assert got[3] == "Komentarz: k9"
    assert got[4] is None and got[2] is None
