"""Every batch query over the test tables, by name."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions import scalar as S
from gradewell.operators import access as AC
from gradewell.operators import bitmaps as BM
from gradewell.operators import cascade as CC
from gradewell.operators import catalog as CA
from gradewell.operators import changes as CH
from gradewell.operators import counts as CO
from gradewell.operators import generate as GE
from gradewell.operators import hierarchy as HI
from gradewell.operators import incremental as IN
from gradewell.operators import publish as PU
from gradewell.operators import quality as QU
from gradewell.operators import ranking as RA
from gradewell.operators import relations as RE
from gradewell.operators import sampling as SA
from gradewell.operators import scoring as SC
from gradewell.schema import NO_ANSWER
from gradewell.plans.flows import submit
from gradewell.sources import indexed as IX
from gradewell.sources import line_blocks as LB
from gradewell.sources import tables as TA
from gradewell.sources.shared import shared_folder, sized, stored
from gradewell.sources.testrequests import Requests
from gradewell.streaming.live_ranking import QuizTables, current_members, replay

SEED = "losowanie"
MADE_AT = "2020-01-01 00:00:00"

_REGISTRY: dict[str, Callable[[Requests], DataFrame]] = {}


def query(fn: Callable[[Requests], DataFrame]) -> Callable[[Requests], DataFrame]:
    _REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Requests(spark, sf_dir))

    return {name: bind(fn) for name, fn in _REGISTRY.items()}


def run(name: str, d: Requests) -> DataFrame:
    """One query over tables that are at hand already."""
    return _REGISTRY[name](d)


def _who(d: Requests) -> dict[str, DataFrame]:
    return {"users": d.uzytkownik, "groups": d.grupa_quizowa, "access": d.dostep_grupa}


def _scores(d: Requests) -> DataFrame:
    return SC.question_scores(d.odpowiedz_uzytkownika, d.pytanie, d.typ, d.odpowiedz_wzorcowa)


def _shown(d: Requests) -> DataFrame:
    return CH.shown_options(d.submissions, d.pytanie, d.typ, d.odpowiedz_wzorcowa, SEED, _gated(d)[0])


def _gated(d: Requests) -> tuple[DataFrame, DataFrame, DataFrame]:
    return CH.gate_submissions(d.submissions, d.quiz, d.grupa_quizowa, d.dostep_grupa)


# Scoring and rankings -----------------------------------------------------------
@query
def question_scores(d):
    return _scores(d)


@query
def question_page(d):
    return SC.question_page(_scores(d)).select("id_uz", "id_pyt", "data_wyslania", "etykieta", "ocena")


@query
def attempt_history(d):
    return SC.attempt_history(_scores(d))


@query
def recompute_ranking(d):
    return d.ranking


@query
def recompute_ranking_last(d):
    return RA.ranking_from_attempts(SC.attempt_history(_scores(d)), d.quiz, "last")


@query
def recompute_ranking_sum(d):
    return RA.ranking_from_attempts(SC.attempt_history(_scores(d)), d.quiz, "sum", include_limbo=True)


@query
def recompute_group_ranking(d):
    # the stored ranking of every group is 1 point too high; invite-only groups are recomputed
    stale = d.ranking.withColumn("pkt", F.col("pkt") + 1)
    groups = d.grupa_quizowa.filter("na_zaproszenie").select("id_grupy")
    return RA.recompute_group_ranking(
        stale, groups, d.odpowiedz_uzytkownika, d.pytanie, d.typ, d.odpowiedz_wzorcowa, d.quiz
    )


@query
def leaderboard(d):
    return RA.leaderboard(d.ranking, **_who(d))


@query
def leaderboard_raw(d):
    return RA.leaderboard_raw(d.ranking, d.uzytkownik)


@query
def attempt_limit_status(d):
    return SC.attempt_limit_status(d.odpowiedz_uzytkownika, d.pytanie, d.quiz)


# Sampling and submissions -------------------------------------------------------
def _draws(d):
    return d.gracze.join(CA.visible_questions(d.pytanie).select("id_quizu", "id_pyt"), "id_quizu")


@query
def sample_options(d):
    return SA.sample_options(_draws(d), d.pytanie, d.typ, d.odpowiedz_wzorcowa, SEED)[0]


@query
def sample_options_errors(d):
    return SA.sample_options(_draws(d), d.pytanie, d.typ, d.odpowiedz_wzorcowa, SEED)[1]


@query
def gate_submissions(d):
    return _gated(d)[0]


@query
def gate_submissions_rejects(d):
    return _gated(d)[1]


@query
def gate_submissions_members(d):
    return _gated(d)[2]


@query
def refused_entries(d):
    return CH.refused_entries(d.submissions, d.pytanie)


@query
def expand_submissions(d):
    return CH.expand_submissions(_shown(d))[0]


@query
def expand_submissions_rejects(d):
    return CH.expand_submissions(_shown(d))[1]


@query
def submission_comments(d):
    return SC.submission_comments(_shown(d))


@query
def answer_ids(d):
    fresh = CH.expand_submissions(_shown(d))[0]
    return CH.with_answer_ids(fresh, d.odpowiedz_uzytkownika).select(
        "id_odp_u", "id_uz", "id_pyt", "data_wyslania", "tresc_odp", "zaznaczona"
    )


# Access -------------------------------------------------------------------------
@query
def has_privileges_edit(d):
    return AC.has_privileges(d.pary.distinct(), "editing_and_deleting_quizzes", **_who(d))


@query
def has_privileges_both(d):
    names = ("participation_in_quizzes", "creation_of_quizzes")
    return AC.has_privileges(d.pary.distinct(), *names, **_who(d))


@query
def has_privileges_unknown(d):
    return AC.has_privileges(d.pary.distinct(), "deleting_users", **_who(d))


@query
def has_privileges_access(d):
    return AC.has_privileges(d.pary.distinct(), "access_to_group", **_who(d))


@query
def privilege_matrix(d):
    return AC.privilege_matrix(d.dostep_grupa)


@query
def quiz_privilege_check(d):
    return AC.quiz_privilege_check(d.prosby_quiz, **_who(d))


@query
def removal_check(d):
    return AC.removal_check(d.wypisy, **_who(d))


@query
def profile_edit_check(d):
    return AC.profile_edit_check(d.edycje_profilu, d.uzytkownik)


@query
def limbo_access(d):
    return AC.limbo_access(d.uzytkownik)


@query
def user_roles(d):
    return AC.user_roles(d.uzytkownik)


# Listings and checks ------------------------------------------------------------
@query
def lookup_by_key(d):
    return CA.lookup_by_key(d.klucze, d.quiz, "id_quizu")[0].select("id_quizu", "nazwa", "id_grupy")


@query
def lookup_missing(d):
    return CA.lookup_by_key(d.klucze, d.quiz, "id_quizu")[1]


@query
def visible_questions(d):
    return CA.visible_questions(d.pytanie)


@query
def active_quizzes(d):
    return CA.active_quizzes(d.quiz)


@query
def quiz_listing(d):
    return CA.quiz_listing(d.gracze, d.quiz, **_who(d))


@query
def visible_groups(d):
    return CA.visible_groups(d.pary, **_who(d))


@query
def visible_groups_documented(d):
    return CA.visible_groups(d.pary, **_who(d), mode="documented")


@query
def group_overview(d):
    return CO.group_overview(d.pary, **_who(d), quizzes=d.quiz)


@query
def groups_except_limbo(d):
    return CA.groups_except_limbo(d.grupa_quizowa, d.uzytkownik)


@query
def limbo_quizzes(d):
    return CA.limbo_quizzes(d.quiz)


@query
def moderators(d):
    return CA.moderators(d.uzytkownik)


@query
def ownership_candidates(d):
    return CA.ownership_candidates(d.propozycje, d.quiz, d.uzytkownik)


@query
def check_containment(d):
    return CA.check_containment(d.zawieranie, d.grupa_quizowa, d.quiz, d.pytanie)


@query
def template_lookup(d):
    return CA.template_lookup(d.szukane, d.odpowiedz_wzorcowa)


@query
def type_by_shape(d):
    """The type that fits the templates a question has now."""
    counted = CO.question_validity(d.pytanie, d.typ, d.odpowiedz_wzorcowa)
    shapes = d.pytanie.join(d.typ, "id_typu").join(counted, "id_pyt").select(
        "id_pyt", "wielokrotnego_wyboru", F.col("odpowiedzi").alias("liczba_odp")
    )
    return CA.type_by_shape(shapes, d.typ)


@query
def group_card(d):
    return CA.group_card(d.grupa_quizowa)


@query
def quiz_header(d):
    return CA.quiz_header(d.quiz)


@query
def choice_lists(d):
    return CA.choice_lists(d.typ, d.kategoria)


@query
def question_editability(d):
    return CA.question_editability(d.edycje_pytan, d.pytanie)


@query
def first_row(d):
    return CA.first_row(d.kategoria, "id_kategorii")


# Associations -------------------------------------------------------------------
@query
def questions_enriched(d):
    return RE.questions_enriched(d.pytanie, d.typ, d.kategoria, d.quiz, d.grupa_quizowa)


@query
def question_options(d):
    return RE.question_options(d.pytanie, d.odpowiedz_wzorcowa)


@query
def question_user_answers(d):
    return RE.question_user_answers(d.pytanie, d.odpowiedz_uzytkownika)


@query
def quiz_contents(d):
    return RE.quiz_contents(d.quiz, d.pytanie)


@query
def group_members(d):
    return RE.group_members(d.grupa_quizowa, d.dostep_grupa, d.uzytkownik)


@query
def member_page(d):
    members = RE.group_members(d.grupa_quizowa, d.dostep_grupa, d.uzytkownik)
    visits = d.wypisy.selectExpr("nr", "id_aktora AS id_widza", "id_grupy", "id_uz")
    return RE.member_page(visits, **_who(d), members=members)


@query
def groups_with_owner(d):
    return RE.groups_with_owner(d.grupa_quizowa, d.uzytkownik)


@query
def ranking_with_user(d):
    return RE.ranking_with_user(d.ranking, d.uzytkownik)


@query
def owned_objects(d):
    return RE.owned_objects(d.uzytkownik, d.quiz, d.grupa_quizowa)


@query
def is_enrolled(d):
    return RE.is_enrolled(d.wizyty, d.dostep_grupa)


@query
def enrolled(d):
    return RE.enrolled(d.wizyty, d.dostep_grupa)


@query
def not_enrolled(d):
    return RE.not_enrolled(d.wizyty, d.dostep_grupa)


@query
def orphans(d):
    """Rows left without a parent when users and questions are dropped with nothing else."""
    tables = d.tables(*ORPHAN_TABLES)
    tables["uzytkownik"] = d.uzytkownik.join(d.uzytkownicy_do_usuniecia, "id_uz", "left_anti")
    tables["pytanie"] = d.pytanie.join(d.pytania_do_usuniecia, "id_pyt", "left_anti")
    return RE.orphans(tables)


ORPHAN_TABLES = [
    "dostep_grupa", "dyskusja", "grupa_quizowa", "kategoria", "odpowiedz_uzytkownika", "odpowiedz_wzorcowa",
    "podkategoria", "quiz", "ranking", "typ",
]


# Bitmaps and indexed files ------------------------------------------------------
@query
def enrolled_by_bitmaps(d):
    return BM.is_enrolled(d.wizyty, BM.right_bitmaps(d.dostep_grupa))


@query
def not_enrolled_by_bitmaps(d):
    return BM.not_enrolled(d.wizyty, BM.right_bitmaps(d.dostep_grupa))


@query
def privileges_by_bitmaps(d):
    return BM.has_privileges(d.pary.distinct(), "editing_and_deleting_quizzes", **_who(d))


@query
def lookup_indexed(d):
    path = shared_folder(d.spark, "indexed")
    IX.write_indexed(d.quiz, path, "id_quizu")
    return IX.lookup_indexed(d.spark, d.klucze, path, "id_quizu")[0].select("id_quizu", "nazwa", "id_grupy")


@query
def template_lookup_indexed(d):
    path = shared_folder(d.spark, "indexed")
    IX.write_indexed(d.odpowiedz_wzorcowa, path, "id_pyt")
    return IX.template_lookup_indexed(d.spark, d.szukane, path)


# Counts -------------------------------------------------------------------------
@query
def member_counts(d):
    return CO.member_counts(d.grupa_quizowa, d.dostep_grupa, d.uzytkownik)


@query
def active_quiz_counts(d):
    return CO.active_quiz_counts(d.grupa_quizowa, d.quiz)


@query
def question_validity(d):
    return CO.question_validity(d.pytanie, d.typ, d.odpowiedz_wzorcowa)


# Column functions ---------------------------------------------------------------
@query
def access_bits(d):
    mask = S.privilege_mask("participation_in_quizzes", "editing_and_deleting_discussions")
    return d.dostep_grupa.select(
        "id_grupy", "id_uz", S.bits_to_int("prawa_dost").alias("prawa"), S.has_bits("prawa_dost", mask).alias("oba")
    )


@query
def text_functions(d):
    return d.raw("documents").select(
        "doc_id",
        S.leading_int("text").alias("liczba"),
        F.md5(S.strip("text")).alias("obciety"),
        S.blank("text").alias("pusty"),
        S.present("text").alias("obecny"),
        S.email_ok("text").alias("email"),
    )


@query
def order_functions(d):
    return d.raw("orders").select(
        "o_orderkey",
        S.leading_int("o_orderpriority").alias("priorytet"),
        S.format_time(F.expr("timestampadd(MILLISECOND, o_orderkey, o_orderdate)")).alias("czas"),
        S.block_of("o_orderkey", 4).alias("blok"),
        S.slot_of("o_orderkey", 4).alias("miejsce"),
    )


@query
def time_round_trip(d):
    texts = d.attempts.select("o_orderkey", S.format_time("data_wyslania").alias("czas"))
    return texts.select("o_orderkey", S.parse_time("czas", zoned=False).alias("data_wyslania"))


@query
def submission_membership(d):
    return d.submissions.select(
        "id_uz",
        "data_wyslania",
        "id_pyt",
        S.is_member("chosen", "A").alias("wybrano_a"),
        S.default_to("open_text", NO_ANSWER).alias("tekst"),
    )


@query
def question_kinds(d):
    return d.pytanie.join(d.typ, "id_typu").select(
        "id_pyt",
        S.question_kind("liczba_odp", "wielokrotnego_wyboru").alias("rodzaj"),
        F.format_string("Pytanie %d: %s", "id_pyt", "tresc").alias("opis"),
    )


# Table changes ------------------------------------------------------------------
@query
def enroll_visits(d):
    return CH.enroll_visits(d.wizyty, d.grupa_quizowa, d.dostep_grupa)[0]


@query
def enroll_visits_rejects(d):
    return CH.enroll_visits(d.wizyty, d.grupa_quizowa, d.dostep_grupa)[1]


@query
def remove_members(d):
    return CH.remove_members(d.wypisy, **_who(d))[0]


@query
def remove_members_rejects(d):
    return CH.remove_members(d.wypisy, **_who(d))[1]


@query
def set_quiz_visibility(d):
    return CH.set_quiz_visibility(d.zmiany_widocznosci, d.quiz)[0]


@query
def set_quiz_visibility_rejects(d):
    return CH.set_quiz_visibility(d.zmiany_widocznosci, d.quiz)[1]


@query
def toggle_questions(d):
    return CH.toggle_questions(d.przelaczenia, d.pytanie, d.typ, d.odpowiedz_wzorcowa)[0]


@query
def toggle_questions_rejects(d):
    return CH.toggle_questions(d.przelaczenia, d.pytanie, d.typ, d.odpowiedz_wzorcowa)[1]


@query
def update_questions(d):
    return CH.update_questions(d.zmiany_pytan, d.pytanie, d.typ, d.odpowiedz_wzorcowa)[0]


@query
def update_questions_rejects(d):
    return CH.update_questions(d.zmiany_pytan, d.pytanie, d.typ, d.odpowiedz_wzorcowa)[1]


@query
def apply_option_changes(d):
    return CH.apply_option_changes(d.zmiany_odpowiedzi, d.odpowiedz_wzorcowa, d.pytanie, d.typ)[0]


@query
def apply_option_changes_rejects(d):
    return CH.apply_option_changes(d.zmiany_odpowiedzi, d.odpowiedz_wzorcowa, d.pytanie, d.typ)[1]


@query
def transfer_ownership(d):
    return CH.transfer_ownership(d.zmiany_wlascicieli, d.quiz)[0]


@query
def transfer_ownership_rejects(d):
    return CH.transfer_ownership(d.zmiany_wlascicieli, d.quiz)[1]


def _move(d):
    return CH.transfer_to_group(
        d.przeniesienia, d.quiz, d.grupa_quizowa, d.ranking, d.odpowiedz_uzytkownika, d.pytanie, d.typ,
        d.odpowiedz_wzorcowa,
    )


@query
def transfer_to_group(d):
    return _move(d)[0]


@query
def transfer_to_group_ranking(d):
    return _move(d)[1]


@query
def transfer_to_group_rejects(d):
    return _move(d)[2]


@query
def delete_quiz_answers(d):
    return CH.delete_quiz_answers(d.zmiany_wlascicieli, d.odpowiedz_uzytkownika, d.pytanie, d.quiz)[0]


@query
def delete_quiz_answers_rejects(d):
    return CH.delete_quiz_answers(d.zmiany_wlascicieli, d.odpowiedz_uzytkownika, d.pytanie, d.quiz)[1]


@query
def create_quizzes(d):
    return CH.create_quizzes(d.nowe_quizy, d.quiz, F.col("kiedy"))


@query
def create_questions(d):
    return CH.create_questions(d.nowe_pytania, d.pytanie, d.typ, d.kategoria, F.col("kiedy"))


@query
def create_groups(d):
    return CH.create_groups(d.nowe_grupy, d.grupa_quizowa, d.uzytkownik)[0]


@query
def create_groups_rejects(d):
    return CH.create_groups(d.nowe_grupy, d.grupa_quizowa, d.uzytkownik)[1]


def _deleted(d):
    return CH.delete_questions_quizzes(
        d.quizy_do_usuniecia, d.pytania_do_usuniecia, d.quiz, d.pytanie, d.odpowiedz_wzorcowa, d.odpowiedz_uzytkownika,
        d.dyskusja,
    )


@query
def delete_quizzes_quiz(d):
    return _deleted(d)["quiz"]


@query
def delete_quizzes_pytanie(d):
    return _deleted(d)["pytanie"]


@query
def delete_quizzes_odpowiedz_wzorcowa(d):
    return _deleted(d)["odpowiedz_wzorcowa"]


@query
def delete_quizzes_odpowiedz_uzytkownika(d):
    return _deleted(d)["odpowiedz_uzytkownika"]


@query
def delete_quizzes_dyskusja(d):
    return _deleted(d)["dyskusja"]


def _users_deleted(d):
    names = ("uzytkownik", "quiz", "grupa_quizowa", "pytanie", "dostep_grupa", "ranking", "odpowiedz_uzytkownika", "dyskusja")
    return CH.delete_users(d.uzytkownicy_do_usuniecia, d.tables(*names))


@query
def delete_users_uzytkownik(d):
    return _users_deleted(d)["uzytkownik"]


@query
def delete_users_quiz(d):
    return _users_deleted(d)["quiz"]


@query
def delete_users_dostep_grupa(d):
    return _users_deleted(d)["dostep_grupa"]


@query
def delete_users_grupa_quizowa(d):
    return _users_deleted(d)["grupa_quizowa"]


@query
def delete_users_pytanie(d):
    return _users_deleted(d)["pytanie"]


@query
def delete_users_ranking(d):
    return _users_deleted(d)["ranking"]


@query
def delete_users_odpowiedz_uzytkownika(d):
    return _users_deleted(d)["odpowiedz_uzytkownika"]


@query
def delete_users_dyskusja(d):
    return _users_deleted(d)["dyskusja"]


@query
def create_users(d):
    return CH.create_users(d.nowi_uzytkownicy, d.uzytkownik)[0]


@query
def create_users_rejects(d):
    return CH.create_users(d.nowi_uzytkownicy, d.uzytkownik)[1]


@query
def update_profiles(d):
    return CH.update_profiles(d.zmiany_profili, d.uzytkownik)[0]


@query
def update_profiles_rejects(d):
    return CH.update_profiles(d.zmiany_profili, d.uzytkownik)[1]


def _groups_deleted(d):
    """Invite-only groups go; their quizzes pass to the holding area."""
    gone = d.grupa_quizowa.filter("na_zaproszenie").select("id_grupy")
    return CC.cascade({"grupa_quizowa": gone}, d.tables("grupa_quizowa", "quiz", "dostep_grupa", "ranking"))


@query
def delete_groups_grupa_quizowa(d):
    return _groups_deleted(d)["grupa_quizowa"]


@query
def delete_groups_quiz(d):
    return _groups_deleted(d)["quiz"]


@query
def delete_groups_dostep_grupa(d):
    return _groups_deleted(d)["dostep_grupa"]


@query
def delete_groups_ranking(d):
    return _groups_deleted(d)["ranking"]


def _categories_deleted(d):
    """The categories right below the root's third child go, with their questions."""
    gone = d.podkategoria.filter("id_nadkategorii = 4").select(F.col("id_podkategorii").alias("id_kategorii"))
    names = ("kategoria", "podkategoria", "pytanie", "odpowiedz_wzorcowa", "odpowiedz_uzytkownika")
    return CC.cascade({"kategoria": gone}, d.tables(*names))


@query
def delete_categories_kategoria(d):
    return _categories_deleted(d)["kategoria"]


@query
def delete_categories_podkategoria(d):
    return _categories_deleted(d)["podkategoria"]


@query
def delete_categories_pytanie(d):
    return _categories_deleted(d)["pytanie"]


@query
def delete_categories_odpowiedz_wzorcowa(d):
    return _categories_deleted(d)["odpowiedz_wzorcowa"]


@query
def delete_categories_odpowiedz_uzytkownika(d):
    return _categories_deleted(d)["odpowiedz_uzytkownika"]


# Generation ---------------------------------------------------------------------
STRIDE = 5


def _blocks(d):
    return LB.question_blocks(LB.text_lines(d.raw("documents"), "doc_id", "text"), STRIDE)


def _generated(d):
    return GE.generate_quiz_set(
        _blocks(d), "dokumenty %d", quizzes=40, answers=4, type_id=3, at=F.lit(MADE_AT).cast("timestamp_ntz"),
        first_quiz_id=101, first_question_id=1001, first_template_id=5001,
    )


@query
def question_blocks(d):
    return _blocks(d).select("zrodlo", "blok", "pytanie", F.array_join("odpowiedzi", "|").alias("odpowiedzi"))


@query
def generate_quiz_set_pytanie(d):
    return _generated(d)["pytanie"]


@query
def generate_quiz_set_quiz(d):
    return _generated(d)["quiz"]


def _chained(d):
    """Three sets from three tables of texts, one after another; the later ones take two lines a question."""
    talk = d.raw("conversations").selectExpr("conv_id * 1000 + turn AS nr", "text")
    texts = {
        "dokumenty": (d.raw("documents"), "doc_id", STRIDE, 4, 3, 40),
        "testy": (d.raw("benchmark"), "item_id", 2, 1, 11, 7),
        "rozmowy": (talk, "nr", 2, 1, 11, 9),
    }
    sets = {
        name: {
            "blocks": LB.question_blocks(LB.text_lines(table, key, "text"), stride), "name": f"{name} %d",
            "quizzes": quizzes, "answers": answers, "type_id": kind,
        }
        for name, (table, key, stride, answers, kind, quizzes) in texts.items()
    }
    return GE.generate_chain(sets, F.lit(MADE_AT).cast("timestamp_ntz"), 101, 1001, 5001)


def _all_sets(d, table):
    return reduce(DataFrame.unionByName, [tables[table] for tables in _chained(d).values()])


@query
def generate_chain_quiz(d):
    return _all_sets(d, "quiz")


@query
def generate_chain_pytanie(d):
    return _all_sets(d, "pytanie")


@query
def generate_chain_odpowiedz(d):
    return _all_sets(d, "odpowiedz_wzorcowa")


@query
def generate_chain_summary(d):
    return GE.generation_summary(_chained(d))


@query
def generate_quiz_set_odpowiedz(d):
    return _generated(d)["odpowiedz_wzorcowa"]


@query
def generation_summary(d):
    return GE.generation_summary({"dokumenty": _generated(d)})


# Data quality -------------------------------------------------------------------
@query
def check_users(d):
    return QU.check_users(d.uzytkownik)


@query
def check_groups(d):
    return QU.check_groups(d.nowe_grupy.withColumnRenamed("nr", "id_grupy"))


@query
def check_questions(d):
    return QU.check_questions(d.zmiany_pytan.drop("id_pyt").withColumnRenamed("nr", "id_pyt"))


@query
def check_templates(d):
    return QU.check_templates(d.zmiany_odpowiedzi.withColumnRenamed("nr", "id_odp_w"), d.pytanie, d.typ)


@query
def check_unique(d):
    tables = d.tables("uzytkownik", "kategoria", "typ", "podkategoria", "dostep_grupa", "ranking")
    tables["grupa_quizowa"] = d.nowe_grupy
    return QU.check_unique(tables)


@query
def check_not_null(d):
    tables = d.tables(
        "uzytkownik", "dostep_grupa", "dyskusja", "odpowiedz_uzytkownika", "odpowiedz_wzorcowa", "kategoria", "podkategoria",
        "ranking", "typ",
    )
    tables["pytanie"] = d.zmiany_pytan
    tables["quiz"] = d.nowe_quizy
    tables["grupa_quizowa"] = d.nowe_grupy
    return QU.check_not_null(tables, partial=("pytanie", "quiz", "grupa_quizowa"))


@query
def check_not_null_tables(d):
    """The tables themselves, with gaps where the given tables have some: users without a name, quizzes without a time."""
    tables = d.tables("pytanie", "quiz", "grupa_quizowa", "odpowiedz_wzorcowa", "dostep_grupa")
    tables["uzytkownik"] = d.uzytkownik.withColumn("nazwa_uz", F.when(F.col("ranga") != "teacher", F.col("nazwa_uz")))
    tables["quiz"] = d.quiz.withColumn("data_utworzenia", F.when(~F.col("ukryty"), F.col("data_utworzenia")))
    return QU.check_not_null(tables)


@query
def publish_tables(d):
    """Rules that rows of the written tables break, as counted while they were written."""
    tables = d.tables("uzytkownik", "grupa_quizowa", "kategoria", "typ", "pytanie", "quiz", "odpowiedz_wzorcowa")
    broken = {("uzytkownik", rule): 1 << 60 for rule in PU.table_rules("uzytkownik", d.uzytkownik.columns)}
    return PU.write_checked(tables, shared_folder(d.spark, "published"), 1, broken)


@query
def published_questions(d):
    path = shared_folder(d.spark, "published")
    PU.write_checked(d.tables("pytanie", "typ"), path, 1)
    PU.write_checked({"pytanie": d.pytanie.filter("NOT ukryty"), "typ": d.typ}, path, 2)
    return PU.read_published(d.spark, path)["pytanie"]


# Stored tables ------------------------------------------------------------------
@query
def stored_quizzes(d):
    path = shared_folder(d.spark, "tables")
    TA.write_tables(d.tables("quiz", "typ"), path)
    return TA.load_tables(d.spark, path, ["quiz", "typ"])["quiz"]


@query
def stored_answers(d):
    path = shared_folder(d.spark, "tables")
    TA.write_tables(d.tables("odpowiedz_uzytkownika"), path)
    return TA.load_table(d.spark, path, "odpowiedz_uzytkownika").drop("dzien")


@query
def stored_submissions(d):
    path = shared_folder(d.spark, "submissions")
    d.submissions.write.parquet(path)
    return TA.read_submissions(d.spark, path).select(
        "id_uz", "id_grupy", "id_quizu", "data_wyslania", "id_pyt", F.array_join(F.array_sort("chosen"), ",").alias("wybrane"), "open_text"
    )


@query
def file_lines(d):
    """The lines of text files, a file for each hundred documents, numbered."""
    path = shared_folder(d.spark, "texts")
    texts = d.raw("documents").filter("text IS NOT NULL").select(F.floor(F.col("doc_id") / 100).alias("plik"), "doc_id", "text")
    texts.repartition("plik").sortWithinPartitions("plik", "doc_id").select("plik", "text").write.partitionBy("plik").text(path)
    lines = LB.file_lines(d.spark, path)
    file = F.regexp_extract("zrodlo", r"plik=(-?\d+)/", 1).cast("long").alias("plik")
    return lines.select(file, "nr_linii", F.md5("linia").alias("linia"))


# Kept by changes ----------------------------------------------------------------
def _attempt_batches(d):
    """Attempts that come first, and a second batch in which others come and some of the first go."""
    attempts = sized(stored(SC.attempt_history(_scores(d)).select(*IN.ATTEMPT), "attempts-scored"))  # for both batches
    first = F.col("id_uz") % 3 != 0
    old = attempts.filter(first).withColumn("zmiana", F.lit(1))
    gone = attempts.filter(first & (F.col("id_quizu") % 5 == 0)).withColumn("zmiana", F.lit(-1))
    return old, attempts.filter(~first).withColumn("zmiana", F.lit(1)).unionByName(gone)


@query
def kept_ranking(d):
    path = shared_folder(d.spark, "attempts")
    best = d.spark.createDataFrame([], "id_uz long, id_quizu long, best double")
    ranking = d.spark.createDataFrame([], "id_uz long, id_grupy long, pkt double, quizy long")
    for number, batch in enumerate(_attempt_batches(d)):
        batch = sized(stored(batch, "attempt-changes"))
        IN.write_attempts(batch, path, number)
        best, moved = IN.changed_best(best, batch, path)
        best, ranking = sized(stored(best, "best")), sized(stored(IN.changed_ranking(ranking, moved, d.quiz), "ranking"))
    return ranking


@query
def kept_member_counts(d):
    share = F.col("id_uz") % 4
    before = CO.member_counts(d.grupa_quizowa, d.dostep_grupa.filter(share != 0), d.uzytkownik)
    changes = d.dostep_grupa.filter(share < 2).select("id_grupy", "id_uz", F.when(share == 0, 1).otherwise(-1).alias("zmiana"))
    return IN.changed_member_counts(before, changes, d.uzytkownik)


@query
def kept_quiz_counts(d):
    """Counts after the batch of visibility changes."""
    after = CH.set_quiz_visibility(d.zmiany_widocznosci, d.quiz)[0].join(d.zmiany_widocznosci.select("id_quizu"), "id_quizu", "left_semi")
    before = d.quiz.join(d.zmiany_widocznosci.select("id_quizu"), "id_quizu", "left_semi")
    return IN.changed_quiz_counts(CO.active_quiz_counts(d.grupa_quizowa, d.quiz), before, after)


# Categories and discussions -----------------------------------------------------
@query
def category_closure(d):
    return HI.category_closure(d.podkategoria)


@query
def category_cycles(d):
    """Sizes of parts as categories, each below the size that its first part's key falls on."""
    edges = d.raw("part").groupBy(F.col("p_size").cast("long").alias("id_podkategorii")).agg(
        (F.min("p_partkey") * 7 % 50 + 1).alias("id_nadkategorii")
    )
    return HI.category_cycles(HI.category_closure(edges))


@query
def quiz_categories(d):
    return HI.quiz_categories(d.pytanie, d.kategoria)


@query
def discussion_feed(d):
    return HI.discussion_feed(d.dyskusja, d.quiz, **_who(d))


# Streaming ----------------------------------------------------------------------
def _live_tables(d: Requests) -> QuizTables:
    # each batch looks at the memberships, so they are worked out once
    access = sized(stored(d.dostep_grupa, "access"))
    return QuizTables(d.pytanie, d.typ, d.odpowiedz_wzorcowa, d.quiz, d.grupa_quizowa, access)


@query
def live_ranking(d):
    tables = _live_tables(d)
    path = shared_folder(d.spark, "live-ranking")
    return replay(d.spark, d.submissions, tables, path, SEED)


@query
def live_members(d):
    """Memberships that the stream has made, with those it began with."""
    tables = _live_tables(d)
    path = shared_folder(d.spark, "live-members")
    replay(d.spark, d.submissions, tables, path, SEED)
    return current_members(d.spark, path, tables.access)


@query
def submit_ranking(d):
    """Submissions to ranking with every step stored."""
    tables = d.tables("pytanie", "typ", "odpowiedz_wzorcowa", "quiz", "grupa_quizowa", "dostep_grupa")
    return submit(d.spark, d.submissions, tables, shared_folder(d.spark, "submit"), SEED)["ranking"]
