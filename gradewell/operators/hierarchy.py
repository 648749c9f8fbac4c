"""Category tree, quiz categories and discussions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.functions.scalar import privilege_mask
from gradewell.operators.access import granted, with_standing
from gradewell.sources.shared import stored


def category_closure(edges: DataFrame) -> DataFrame:
    """All (id_przodka, id_potomka, glebokosc) pairs of the category tree, at the smallest depth.

    Path doubling: pairs up to depth d, met with those of depth d exactly, give all pairs up to 2d,
    so a tree of depth n takes log2(n) rounds and every round's work is the pairs it
    finds. Rounds are written to the shared folder. There is no limit to the depth. A category on a
    cycle is its own descendant, see ``category_cycles``. Edges with a null end are left out.
    """
    pairs = edges.filter("id_nadkategorii IS NOT NULL AND id_podkategorii IS NOT NULL").select(
        F.col("id_nadkategorii").alias("id_przodka"), F.col("id_podkategorii").alias("id_potomka"), F.lit(1).alias("glebokosc")
    )
    known, depth = stored(pairs.distinct(), "closure"), 1
    while True:
        far = known.filter(F.col("glebokosc") == depth).select("id_przodka", F.col("id_potomka").alias("_przez"))
        if far.isEmpty():
            return known
        beyond = far.join(known.withColumnRenamed("id_przodka", "_przez"), "_przez").select(
            "id_przodka", "id_potomka", (F.col("glebokosc") + depth).alias("glebokosc")
        )
        shortest = known.unionByName(beyond).groupBy("id_przodka", "id_potomka").agg(F.min("glebokosc").alias("glebokosc"))
        known, depth = stored(shortest, "closure"), 2 * depth


def category_cycles(closure: DataFrame) -> DataFrame:
    """The categories that are their own descendants, each with its cycle, which is named by its
    smallest member, and the cycle's length on the way back to itself."""
    own = closure.filter("id_przodka = id_potomka").select(F.col("id_przodka").alias("id_kategorii"), F.col("glebokosc").alias("dlugosc"))
    down = closure.select(F.col("id_przodka").alias("id_kategorii"), F.col("id_potomka").alias("_inna"))
    up = closure.select(F.col("id_potomka").alias("id_kategorii"), F.col("id_przodka").alias("_inna"))
    members = down.join(own, "id_kategorii", "left_semi").join(up, ["id_kategorii", "_inna"])
    return members.groupBy("id_kategorii").agg(F.min("_inna").alias("cykl")).join(own, "id_kategorii").select("cykl", "id_kategorii", "dlugosc")


def quiz_categories(questions: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories a quiz has through its questions."""
    return (
        questions.select("id_quizu", "id_kategorii")
        .distinct()
        .join(categories.select("id_kategorii", F.col("nazwa").alias("kategoria")), "id_kategorii")
        .select("id_quizu", "id_kategorii", "kategoria")
    )


def discussion_feed(
    posts: DataFrame, quizzes: DataFrame, users: DataFrame, groups: DataFrame, access: DataFrame
) -> DataFrame:
    """Posts whose author may take part in the discussions of the quiz's group."""
    placed = posts.join(quizzes.select("id_quizu", "id_grupy"), "id_quizu")
    may = granted(privilege_mask("participation_in_discussions"))
    return (
        with_standing(placed, users, groups, access, user_columns=("nazwa_uz",))
        .filter(may & F.col("_ranga").isNotNull())
        .select("id_quizu", "id_grupy", "id_uz", "nazwa_uz", "tresc", "data_wyslania")
    )
