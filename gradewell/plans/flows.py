"""Operators put together the way the application uses them."""

from pyspark.sql import DataFrame, SparkSession

from gradewell.operators.changes import expand_submissions, judged_submissions, shown_options, sorted_submissions
from gradewell.operators.ranking import leaderboard, ranking_from_attempts
from gradewell.operators.scoring import attempt_history, question_scores


def submit(
    spark: SparkSession, submissions: DataFrame, tables: dict[str, DataFrame], path: str, seed: str
) -> dict[str, DataFrame]:
    """Submissions that pass the gates to stored answers, attempts and ranking; also the
    refused forms and the memberships that come of it.

    Each step is written under ``path`` and the next one reads it from there:
    nothing is worked out twice, and a lost executor costs one step at most.
    """
    kinds = [tables[name] for name in ("pytanie", "typ", "odpowiedz_wzorcowa")]

    def stored(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    access = tables["dostep_grupa"].select("id_grupy", "id_uz", "prawa_dost")
    judged = stored("osadzone", judged_submissions(submissions, tables["quiz"], tables["grupa_quizowa"], access))
    accepted, refused, entered = sorted_submissions(judged)
    accepted = stored("przyjete", accepted)
    answers, _ = expand_submissions(shown_options(submissions, *kinds, seed, accepted))
    answers = stored("odpowiedz_uzytkownika", answers)
    attempts = stored("podejscia", attempt_history(question_scores(answers, *kinds)))
    ranking = stored("ranking", ranking_from_attempts(attempts, tables["quiz"]))
    return {
        "odpowiedz_uzytkownika": answers,
        "podejscia": attempts,
        "ranking": ranking,
        "odrzucone": stored("odrzucone", refused),
        "dostep_grupa": stored("dostep_grupa", access.unionByName(entered)),
    }


def group_boards(ranking: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The leaderboard page of every group."""
    return leaderboard(ranking, tables["uzytkownik"], tables["grupa_quizowa"], tables["dostep_grupa"])
