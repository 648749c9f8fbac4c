"""Counts per group and the validity of questions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.operators.access import is_superuser, not_limbo_user
from gradewell.operators.catalog import active_quizzes, group_card, listed_groups
from gradewell.operators.skew import own_shuffle


def _members_per_group(access: DataFrame, users: DataFrame) -> DataFrame:
    counted_users = users.filter(~is_superuser() & not_limbo_user()).select("id_uz")
    return (
        access.select("id_uz", "id_grupy")
        .join(counted_users, "id_uz", "left_semi")
        .groupBy("id_grupy")
        .agg(F.count("*").alias("_uzytkownicy"))
    )


def _quizzes_per_group(quizzes: DataFrame) -> DataFrame:
    return active_quizzes(quizzes).groupBy("id_grupy").agg(F.count("*").alias("_quizy"))


def member_counts(groups: DataFrame, access: DataFrame, users: DataFrame) -> DataFrame:
    """Members per group without superusers and the limbo user; empty groups give 0.

    Memberships are counted before they meet the groups, so a group that holds
    most users arrives at the join as one row.
    """
    return groups.join(_members_per_group(access, users), "id_grupy", "left").select(
        "id_grupy", F.coalesce("_uzytkownicy", F.lit(0)).alias("uzytkownicy")
    )


def active_quiz_counts(groups: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Active quizzes per group, 0 where there is none."""
    return groups.join(_quizzes_per_group(quizzes), "id_grupy", "left").select(
        "id_grupy", F.coalesce("_quizy", F.lit(0)).alias("quizy")
    )


def group_overview(
    requests: DataFrame,
    users: DataFrame,
    groups: DataFrame,
    access: DataFrame,
    quizzes: DataFrame,
    mode: str = "as_coded",
) -> DataFrame:
    """The group index page: one row per asked (id_uz, id_grupy) that the viewer sees."""
    cards = (
        group_card(groups, "id_wlasciciela")
        .join(_members_per_group(access, users), "id_grupy", "left")
        .join(_quizzes_per_group(quizzes), "id_grupy", "left")
    )
    seen = listed_groups(requests, users, groups, access, mode)
    return seen.join(own_shuffle(cards, "id_grupy"), "id_grupy").select(
        "id_uz",
        "id_grupy",
        "place",
        "nazwa",
        F.coalesce("_uzytkownicy", F.lit(0)).alias("uzytkownicy"),
        F.coalesce("_quizy", F.lit(0)).alias("quizy"),
        "na_zaproszenie",
        "chroniona_haslem",
        "zapisany",
        (F.col("zapisany") & (F.col("id_uz") != F.col("id_wlasciciela"))).alias("moze_sie_wypisac"),
    )


def question_validity(questions: DataFrame, types: DataFrame, templates: DataFrame) -> DataFrame:
    """Enough templates for the type, and a fully right one unless multi-choice."""
    counted = templates.groupBy("id_pyt").agg(
        F.count("*").alias("odpowiedzi"),
        F.count_if(F.col("poziom_poprawnosci") == 100).alias("w_pelni_poprawne"),
    )
    enough = F.col("odpowiedzi") >= F.col("liczba_odp")
    right = F.col("wielokrotnego_wyboru") | (F.col("w_pelni_poprawne") > 0)
    return (
        questions.select("id_pyt", "id_typu")
        .join(types.select("id_typu", "liczba_odp", "wielokrotnego_wyboru"), "id_typu")
        .join(counted, "id_pyt", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("odpowiedzi", "w_pelni_poprawne")})
        .select("id_pyt", "odpowiedzi", "w_pelni_poprawne", (enough & right).alias("poprawne"))
    )
