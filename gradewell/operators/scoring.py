"""Points per question and per attempt, comments, attempt limits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.scalar import points, question_kind, score_band, score_label
from gradewell.operators.skew import own_shuffle
from gradewell.schema import COMMENT_PREFIX

ATTEMPT = ["id_uz", "data_wyslania"]


def _text(column: Column, normalize: bool) -> Column:
    return F.lower(F.trim(column)) if normalize else column


def answer_key(templates: DataFrame, normalize: bool = False) -> DataFrame:
    """One row per question with the level of each text (``_levels``), so that joining answers never
    adds rows; ``normalize`` adds those of the trimmed lower-case texts (``_loose``)."""
    # spread by question first, so that both groupings find their rows in place
    texts = templates.select("id_pyt", "tresc_odp", "poziom_poprawnosci").repartition("id_pyt")
    named = {"_levels": False, "_loose": True} if normalize else {"_levels": False}

    def levels(loose: bool) -> DataFrame:
        text = _text(F.col("tresc_odp"), loose).alias("_text")
        best = texts.groupBy("id_pyt", text).agg(F.max("poziom_poprawnosci").alias("_level")).filter("_text IS NOT NULL")
        return best.groupBy("id_pyt").agg(F.map_from_entries(F.collect_list(F.struct("_text", "_level"))).alias("_map"))

    found = [levels(loose).withColumnRenamed("_map", name) for name, loose in named.items()]
    return found[0].join(found[1], "id_pyt", "full") if normalize else found[0]


def question_scores(
    answers: DataFrame,
    questions: DataFrame,
    types: DataFrame,
    templates: DataFrame,
    normalize: bool = False,
) -> DataFrame:
    """Points of every (user, question, submission).

    single: exactly one ticked option gives ``pkt * level / 100``;
    multi: all of ``pkt`` when every shown option is ticked as its level says;
    open: ``pkt * level / 100`` of the template with the same text.

    Answers are shuffled by attempt, where the rows of a submission lie together and
    compress well, and become one row per (submission, question). These meet
    one row per question, with its texts' levels: AQE can split popular questions there.
    ``normalize`` makes open answers match by trimmed lower-case text.
    """
    entry = F.struct(F.col("tresc_odp").alias("text"), F.col("zaznaczona").alias("ticked"))
    given = (
        answers.select(*ATTEMPT, "id_pyt", "tresc_odp", "zaznaczona")
        .repartition(*ATTEMPT)
        .groupBy(*ATTEMPT, "id_pyt")
        .agg(F.sort_array(F.collect_list(entry)).alias("_given"))  # in order, as equal lists compress well
    )
    shape = questions.join(types, "id_typu").select(
        "id_pyt",
        "id_quizu",
        "pkt",
        question_kind("liczba_odp", "wielokrotnego_wyboru").alias("rodzaj"),
    )
    known = own_shuffle(shape.join(answer_key(templates, normalize), "id_pyt", "left"), "id_pyt")

    def level_of(text: Column, levels: str) -> Column:
        return F.coalesce(F.col(levels)[text], F.lit(0))

    exact = lambda e: level_of(e["text"], "_levels")
    loose = (lambda e: level_of(_text(e["text"], True), "_loose")) if normalize else exact
    ticked = F.filter("_given", lambda e: e["ticked"])
    judged = F.filter("_given", lambda e: e["ticked"].isNotNull())
    all_right = (F.size(judged) > 0) & F.forall(judged, lambda e: e["ticked"] == (exact(e) == 100))
    level = (
        F.when(F.col("rodzaj") == "multi", F.when(all_right, 100).otherwise(0))
        .when(F.col("rodzaj") == "open", F.array_max(F.transform("_given", loose)))
        .otherwise(F.when(F.size(ticked) == 1, F.array_max(F.transform(ticked, exact))).otherwise(0))
    )
    share = F.col("pkt") * F.coalesce(level, F.lit(0)) / 100
    return given.join(known, "id_pyt").select(
        "id_uz",
        "id_pyt",
        "id_quizu",
        "data_wyslania",
        "rodzaj",
        points(share).alias("zdobyte_pkt"),
        F.col("pkt").alias("max_pkt"),
    )


def question_page(scores: DataFrame) -> DataFrame:
    """Question points with the label and colour band shown next to them."""
    return scores.withColumns(
        {
            "etykieta": score_label("zdobyte_pkt", "max_pkt"),
            "ocena": score_band("zdobyte_pkt", "max_pkt"),
        }
    )


def attempt_history(scores: DataFrame) -> DataFrame:
    """Points gained and available per (user, quiz, submission).

    Whole-number columns drop the fraction; the band is taken from them.
    """
    return (
        scores.groupBy(*ATTEMPT, "id_quizu")
        .agg(points(F.sum("zdobyte_pkt")).alias("zdobyte_pkt"), points(F.sum("max_pkt")).alias("max_pkt"))
        .withColumns(
            {
                "zdobyte_calk": F.col("zdobyte_pkt").cast("int"),
                "max_calk": F.col("max_pkt").cast("int"),
            }
        )
        .withColumn("ocena", score_band("zdobyte_calk", "max_calk"))
    )


def submission_comments(shown: DataFrame) -> DataFrame:
    """Comments of the ticked options per (user, question, submission), in shown order.

    ``shown``: id_uz, id_pyt, data_wyslania, place, zaznaczona, komentarz, one
    row per option put before the user (see ``changes.shown_options``).
    """
    joined = F.expr("listagg(CASE WHEN zaznaczona THEN komentarz END, '') WITHIN GROUP (ORDER BY place)")
    return (
        shown.groupBy("id_uz", "id_pyt", "data_wyslania")
        .agg(joined.alias("_text"))
        .select(
            "id_uz",
            "id_pyt",
            "data_wyslania",
            F.when(F.length("_text") > 0, F.concat(F.lit(COMMENT_PREFIX), "_text")).alias("komentarz"),
        )
    )


def attempt_limit_status(answers: DataFrame, questions: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Attempts used and left per (user, quiz); no limit means never exhausted."""
    used = (
        answers.select(*ATTEMPT, "id_pyt")
        .join(questions.select("id_pyt", "id_quizu"), "id_pyt")
        .select(*ATTEMPT, "id_quizu")
        .distinct()
        .groupBy("id_uz", "id_quizu")
        .agg(F.count("*").alias("podejscia"))
    )
    limit = F.col("limit_podejsc")
    return used.join(quizzes.select("id_quizu", "limit_podejsc"), "id_quizu").select(
        "id_uz",
        "id_quizu",
        "podejscia",
        "limit_podejsc",
        F.when(limit.isNotNull(), F.greatest(limit - F.col("podejscia"), F.lit(0))).alias("pozostalo"),
        F.coalesce(F.col("podejscia") >= limit, F.lit(False)).alias("wyczerpane"),
    )
