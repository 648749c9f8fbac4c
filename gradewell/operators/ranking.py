"""Points per user and group, and the leaderboards."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.functions.scalar import points, privilege_mask
from gradewell.operators.access import granted, with_standing
from gradewell.operators.numbering import numbered
from gradewell.operators.scoring import attempt_history, question_scores
from gradewell.schema import LIMBO_GROUP


def ranking_from_attempts(
    attempts: DataFrame, quizzes: DataFrame, attempt_rule: str = "best", include_limbo: bool = False
) -> DataFrame:
    """Ranking rows from ``attempt_history``.

    ``attempt_rule``: which attempts of a quiz count - ``best``, ``last`` or ``sum``.
    """
    gained = {
        "best": F.max("zdobyte_pkt"),
        "last": F.max_by("zdobyte_pkt", "data_wyslania"),
        "sum": F.sum("zdobyte_pkt"),
    }[attempt_rule]
    per_quiz = attempts.groupBy("id_uz", "id_quizu").agg(gained.alias("_pkt"))
    owner_groups = quizzes.select("id_quizu", "id_grupy")
    if not include_limbo:
        owner_groups = owner_groups.filter(F.col("id_grupy") != LIMBO_GROUP)
    return (
        per_quiz.join(owner_groups, "id_quizu")
        .groupBy("id_uz", "id_grupy")
        .agg(points(F.sum("_pkt")).alias("pkt"))
    )


def recompute_ranking(
    answers: DataFrame,
    questions: DataFrame,
    types: DataFrame,
    templates: DataFrame,
    quizzes: DataFrame,
    attempt_rule: str = "best",
    include_limbo: bool = False,
) -> DataFrame:
    """Points of every user in every group, from all answers."""
    scores = question_scores(answers, questions, types, templates)
    return ranking_from_attempts(attempt_history(scores), quizzes, attempt_rule, include_limbo)


def recompute_group_ranking(
    ranking: DataFrame,
    group_ids: DataFrame,
    answers: DataFrame,
    questions: DataFrame,
    types: DataFrame,
    templates: DataFrame,
    quizzes: DataFrame,
    attempt_rule: str = "best",
) -> DataFrame:
    """Recomputes the rows of ``group_ids`` and keeps the others.

    Answers of other groups meet no question and are not scored. They are not looked for before:
    that would shuffle all answers once more.
    """
    wanted = group_ids.select("id_grupy")
    their_quizzes = quizzes.join(wanted, "id_grupy", "left_semi")
    their_questions = questions.join(their_quizzes, "id_quizu", "left_semi")
    fresh = recompute_ranking(answers, their_questions, types, templates, their_quizzes, attempt_rule, include_limbo=True)
    kept = ranking.join(wanted, "id_grupy", "left_anti")
    return kept.select("id_uz", "id_grupy", "pkt").unionByName(fresh.select("id_uz", "id_grupy", "pkt"))


def placed(ranking: DataFrame) -> DataFrame:
    """Place of each user in the group: points descending, ties by id."""
    return numbered(ranking.select("id_grupy", "id_uz", "pkt"), [F.desc("pkt"), F.col("id_uz")], by=["id_grupy"])


def leaderboard(ranking: DataFrame, users: DataFrame, groups: DataFrame, access: DataFrame) -> DataFrame:
    """The group leaderboards.

    Places are given before users without participation rights are left out,
    so numbers may be missing.
    """
    may_play = granted(privilege_mask("participation_in_quizzes"))
    return (
        with_standing(placed(ranking), users, groups, access, user_columns=("nazwa_uz",))
        .filter(may_play & F.col("_ranga").isNotNull())
        .select("id_grupy", "place", "id_uz", "nazwa_uz", "pkt")
    )


def leaderboard_raw(ranking: DataFrame, users: DataFrame) -> DataFrame:
    """All rows per group, points descending, without places or rights."""
    return (
        ranking.join(users.select("id_uz", "nazwa_uz"), "id_uz")
        .select("id_grupy", "id_uz", "nazwa_uz", "pkt")
        .orderBy("id_grupy", F.desc("pkt"), "id_uz")
    )
