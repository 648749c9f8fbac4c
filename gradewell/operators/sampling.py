"""Reproducible draw of the answer options put before a user."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.scalar import question_kind
from gradewell.operators.skew import own_shuffle

OPTION = ["id_odp_w", "tresc_odp", "poziom_poprawnosci", "komentarz"]


def drawable_options(questions: DataFrame, types: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per question with its templates (``_opcje``) and what a draw needs to know.

    ``_first_full`` is the question's lowest-id template at level 100, ``blad`` marks
    a question that has none. A question without templates has one empty option.
    """
    # spread by question first: the rows of a question then need no shuffle as an array
    texts = templates.select("id_pyt", *OPTION).repartition("id_pyt")
    offered = texts.groupBy("id_pyt").agg(F.collect_list(F.struct(*OPTION)).alias("_opcje"))
    kind = question_kind("liczba_odp", "wielokrotnego_wyboru").alias("rodzaj")
    ids = F.transform(F.filter("_opcje", lambda o: o["poziom_poprawnosci"] == 100), lambda o: o["id_odp_w"])
    types_of = dict(templates.dtypes)
    empty = F.array(F.struct(*[F.lit(None).cast(types_of[c]).alias(c) for c in OPTION]))
    return (
        questions.select("id_pyt", "id_quizu", "id_typu")
        .join(types.select("id_typu", "liczba_odp", "wielokrotnego_wyboru"), "id_typu")
        .join(offered, "id_pyt", "left")
        .withColumn("_first_full", F.array_min(ids))
        .select(
            "id_pyt",
            "id_quizu",
            "liczba_odp",
            kind,
            F.coalesce("_opcje", empty).alias("_opcje"),
            "_first_full",
            F.col("_first_full").isNull().alias("blad"),
        )
    )


def draw_order(seed: str, option: Column, user: str = "id_uz") -> Column:
    """Sort key of an option for a user: a digest, so any engine can repeat the draw."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(user).cast("string"), option.cast("string")))


def draw_options(asked: DataFrame, seed: str) -> DataFrame:
    """Draws from ``asked``, rows of ``drawable_options`` given to users.

    ``liczba_odp`` options are taken in digest order. If none of them is at level
    100, the first gives way to the question's first template that is.

    A draw is one row, which has all options of its question, so nothing is shuffled.
    """
    ordered = F.array_sort(
        F.transform("_opcje", lambda o: F.struct(draw_order(seed, o["id_odp_w"]).alias("_digest"), o["id_odp_w"].alias("_id"), o.alias("_o")))
    )
    taken_ones = F.filter("_kolejno", lambda x, i: i < F.col("liczba_odp"))
    first = F.coalesce(F.col("id_odp_w") == F.col("_first_full"), F.lit(False))
    taken = F.col("_nr") <= F.col("liczba_odp")
    swap = ~F.col("_has_full") & ~F.col("blad")
    others = [c for c in asked.columns if c != "_opcje"]
    drawn = (
        asked.withColumn("_kolejno", ordered)
        .withColumn("_has_full", F.exists(taken_ones, lambda x: F.coalesce(x["_o"]["poziom_poprawnosci"] == 100, F.lit(False))))
        .select(*others, "_has_full", F.posexplode("_kolejno").alias("_pos", "_x"))
        .select(*others, "_has_full", (F.col("_pos") + 1).alias("_nr"), "_x._o.*")
        .filter(F.when(swap, first | (taken & (F.col("_nr") > 1))).otherwise(taken))
        .withColumn("place", F.when(swap & first, 1).otherwise(F.col("_nr")).cast("bigint"))
    )
    return drawn.drop("_nr", "_has_full", "_first_full", "liczba_odp")


def sample_options(
    draws: DataFrame, questions: DataFrame, types: DataFrame, templates: DataFrame, seed: str
) -> tuple[DataFrame, DataFrame]:
    """Options drawn per (id_uz, id_pyt), and the draws that have no right option."""
    options = own_shuffle(drawable_options(questions, types, templates), "id_pyt")
    wanted = draws.select("id_uz", "id_pyt").distinct()
    drawn = draw_options(wanted.join(options.filter("NOT blad"), "id_pyt"), seed)
    failed = wanted.join(options.filter("blad").select("id_pyt"), "id_pyt", "left_semi")
    return drawn.select("id_uz", "id_pyt", "place", *OPTION), failed.select("id_uz", "id_pyt")
