from gradewell.operators import changes as CH
from gradewell.operators.ranking import recompute_ranking
from gradewell.plans.flows import group_boards, submit
from tests.conftest import rows


def test_submit_stores_every_step(spark, domain, tmp_path):
    tables = domain.tables("pytanie", "typ", "odpowiedz_wzorcowa", "quiz", "uzytkownik", "grupa_quizowa", "dostep_grupa")
    made = submit(spark, domain.submissions, tables, str(tmp_path), "s")
    gates = CH.gate_submissions(domain.submissions, domain.quiz, domain.grupa_quizowa, domain.dostep_grupa)
    shown = CH.shown_options(
        domain.submissions, domain.pytanie, domain.typ, domain.odpowiedz_wzorcowa, "s", gates[0]
    )
    answers, _ = CH.expand_submissions(shown)
    assert rows(made["odpowiedz_uzytkownika"], *answers.columns) == rows(answers)
    want = recompute_ranking(answers, domain.pytanie, domain.typ, domain.odpowiedz_wzorcowa, domain.quiz)
    assert rows(made["ranking"], "id_uz", "id_grupy", "pkt") == rows(want, "id_uz", "id_grupy", "pkt")
    forms = domain.submissions.select("id_uz", "data_wyslania").distinct().count()
    refused = made["odrzucone"].count()
    assert 0 < refused < forms and made["podejscia"].count() == forms - refused
    assert rows(made["dostep_grupa"]) == rows(gates[2])
    assert group_boards(made["ranking"], tables).count() > 0
