"""Listings, predicates and request checks.

A page of the web application shows a list to one viewer. Writing out every
list of every viewer is a product of two growing tables, so these operators take
the (viewer, item) rows that are asked for and answer each with key joins. Places
in a list are exact all the same, see ``visible_groups``.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.functions.scalar import blank, privilege_mask, yes_no
from gradewell.operators.access import granted, is_superuser, not_limbo_user, with_standing
from gradewell.operators.numbering import PART, numbered_by_id, swept
from gradewell.operators.relations import groups_with_owner
from gradewell.operators.skew import own_shuffle, without
from gradewell.schema import LIMBO_GROUP


def lookup_by_key(keys: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the wanted keys, and the keys that are missing."""
    wanted = keys.select(key).distinct()
    return wanted.join(table, key), without(wanted, table, [key])


def visible_questions(questions: DataFrame) -> DataFrame:
    return questions.filter(~F.col("ukryty"))


def active_quizzes(quizzes: DataFrame) -> DataFrame:
    return quizzes.filter(~F.col("ukryty"))


def quiz_listing(
    requests: DataFrame, quizzes: DataFrame, users: DataFrame, groups: DataFrame, access: DataFrame
) -> DataFrame:
    """Rows (id_uz, id_quizu) that the group page shows: active, or the viewer may edit."""
    asked = requests.select("id_uz", "id_quizu").join(
        quizzes.select("id_quizu", "id_grupy", "nazwa", "ukryty"), "id_quizu"
    )
    may_edit = granted(privilege_mask("editing_and_deleting_quizzes"))
    return (
        with_standing(asked, users, groups, access)
        .withColumns({"moze_grac": ~F.col("ukryty"), "moze_edytowac": may_edit})
        .filter(F.col("moze_grac") | F.col("moze_edytowac"))
        .select("id_uz", "id_grupy", "id_quizu", "nazwa", "moze_grac", "moze_edytowac")
    )


def visible_groups(
    requests: DataFrame, users: DataFrame, groups: DataFrame, access: DataFrame, mode: str = "as_coded"
) -> DataFrame:
    """Rows (id_uz, id_grupy) that the group list of the viewer shows, with their place in it.

    ``as_coded`` hides an invite-only group from the members enrolled in it,
    ``documented`` hides it from everybody else. Superusers see all groups; the
    limbo group is never listed.

    The place needs no list per viewer: it is the group's place in a shared
    list, corrected by the viewer's own invite-only memberships before it.
    """
    return listed_groups(requests, users, groups, access, mode).select("id_uz", "id_grupy", "place")


def listed_groups(
    requests: DataFrame, users: DataFrame, groups: DataFrame, access: DataFrame, mode: str = "as_coded"
) -> DataFrame:
    """``visible_groups`` with a flag: is the viewer a member."""
    as_coded = mode == "as_coded"
    is_open = (~F.col("na_zaproszenie")).cast("long")
    shared = swept(
        groups.filter(F.col("id_grupy") != LIMBO_GROUP).select("id_grupy", "na_zaproszenie"),
        [F.col("id_grupy")],
        {"_all_place": F.lit(1).cast("long"), "_open_place": is_open},
    )
    # one sweep per viewer: the viewer, then for each group what is asked for and the membership
    asked = requests.select("id_uz", "id_grupy", F.lit(1).alias("_asked"), F.lit(0).alias("_member"))
    member = access.select("id_uz", "id_grupy", F.lit(0).alias("_asked"), F.lit(1).alias("_member")).distinct()
    marks = asked.unionByName(member).join(shared, "id_grupy")
    viewers = users.select("id_uz", is_superuser().cast("long").alias("_rank"))
    own = F.when(F.col("na_zaproszenie"), F.col("_member")).otherwise(0).cast("long")
    seen = swept(
        marks.unionByName(viewers, allowMissingColumns=True),
        [F.col("id_grupy")],
        {
            "_own_before": own,
            "_known": F.col("_rank").isNotNull().cast("long"),
            "_super": F.coalesce("_rank", F.lit(0).cast("long")),
        },
        by=["id_uz"],
        ties=[F.desc("_asked")],
        keep_part=True,
    )
    pair = Window.partitionBy(PART, "id_uz", "id_grupy")
    seen = seen.withColumns(
        {"_member": F.max("_member").over(pair), "_nr": F.row_number().over(pair.orderBy(F.desc("_asked")))}
    )
    superuser, is_member = F.col("_super") > 0, F.col("_member") == 1
    hidden = F.col("na_zaproszenie") & (is_member if as_coded else ~is_member)
    if as_coded:
        place = F.col("_all_place") - F.when(superuser, 0).otherwise(F.col("_own_before"))
    else:
        own_place = F.col("_open_place") + F.col("_own_before") + F.col("na_zaproszenie").cast("int")
        place = F.when(superuser, F.col("_all_place")).otherwise(own_place)
    return seen.filter((F.col("_asked") == 1) & (F.col("_nr") == 1) & (F.col("_known") > 0) & (superuser | ~hidden)).select(
        "id_uz", "id_grupy", place.cast("bigint").alias("place"), is_member.alias("zapisany")
    )


def groups_except_limbo(groups: DataFrame, users: DataFrame) -> DataFrame:
    """Groups a quiz can be moved to, with their owner's name."""
    return groups_with_owner(groups.filter(F.col("id_grupy") != LIMBO_GROUP), users)


def limbo_quizzes(quizzes: DataFrame) -> DataFrame:
    return quizzes.filter(F.col("id_grupy") == LIMBO_GROUP).select("id_quizu", "nazwa")


def moderators(users: DataFrame) -> DataFrame:
    """Superusers except the limbo user, numbered."""
    chosen = users.filter(is_superuser() & not_limbo_user()).select("id_uz", "nazwa_uz", "ranga")
    return numbered_by_id(chosen, "id_uz")


def ownership_candidates(proposals: DataFrame, quizzes: DataFrame, users: DataFrame) -> DataFrame:
    """Which proposed owners (id_quizu, id_uz) the form offers: neither limbo nor the present owner."""
    return (
        proposals.select("id_quizu", "id_uz")
        .filter(not_limbo_user())
        .join(quizzes.select("id_quizu", "id_wlasciciela"), "id_quizu")
        .filter(F.col("id_uz") != F.col("id_wlasciciela"))
        .join(users.select("id_uz", "nazwa_uz", "ranga"), "id_uz")
        .select("id_quizu", "id_uz", "nazwa_uz", "ranga")
    )


def check_containment(
    requests: DataFrame, groups: DataFrame, quizzes: DataFrame, questions: DataFrame
) -> DataFrame:
    """Do (id_grupy, id_quizu, id_pyt) lie in one another; a null id_pyt asks about the quiz only."""
    g = groups.select("id_grupy", F.lit(True).alias("_grupa"))
    q = quizzes.select("id_quizu", F.col("id_grupy").alias("_grupa_quizu"))
    p = questions.select("id_pyt", F.col("id_quizu").alias("_quiz_pyt"))
    verdict = (
        F.when(F.col("_grupa").isNull(), "no_group")
        .when(F.col("_grupa_quizu").isNull(), "no_quiz")
        .when(F.col("_grupa_quizu") != F.col("id_grupy"), "quiz_not_in_group")
        .when(F.col("id_pyt").isNull(), "ok")
        .when(F.col("_quiz_pyt").isNull(), "no_question")
        .when(F.col("_quiz_pyt") != F.col("id_quizu"), "question_not_in_quiz")
        .otherwise("ok")
    )
    return (
        requests.join(g, "id_grupy", "left")
        .join(q, "id_quizu", "left")
        .join(p, "id_pyt", "left")
        .select("id_grupy", "id_quizu", "id_pyt", verdict.alias("werdykt"))
    )


def template_lookup(lookups: DataFrame, templates: DataFrame) -> DataFrame:
    """Template answer by (id_pyt, tresc_odp); the lowest id when several match."""
    first = templates.groupBy("id_pyt", "tresc_odp").agg(
        F.min("id_odp_w").alias("id_odp_w"),
        F.min_by("poziom_poprawnosci", "id_odp_w").alias("poziom_poprawnosci"),
    )
    return lookups.join(own_shuffle(first, "id_pyt"), ["id_pyt", "tresc_odp"])


def type_by_shape(requests: DataFrame, types: DataFrame) -> DataFrame:
    """First type with the wanted option count and multi flag."""
    first = types.groupBy("liczba_odp", "wielokrotnego_wyboru").agg(F.min("id_typu").alias("id_typu"))
    return requests.join(first, ["liczba_odp", "wielokrotnego_wyboru"])


def group_card(groups: DataFrame, *more: str) -> DataFrame:
    """Name and yes/no labels of each group, and the columns named in ``more``."""
    return groups.select(
        "id_grupy",
        "nazwa",
        *more,
        yes_no(F.col("na_zaproszenie")).alias("na_zaproszenie"),
        yes_no(~blank("haslo")).alias("chroniona_haslem"),
    )


def quiz_header(quizzes: DataFrame) -> DataFrame:
    """Quiz information; limits that are not set stay null."""
    return quizzes.select("id_quizu", "nazwa", "data_utworzenia", "limit_czasowy", "limit_podejsc")


def choice_lists(types: DataFrame, categories: DataFrame) -> DataFrame:
    """(name, id) pairs offered by the question form."""
    return types.select(F.lit("typ").alias("lista"), "nazwa", F.col("id_typu").alias("id")).unionByName(
        categories.select(F.lit("kategoria").alias("lista"), "nazwa", F.col("id_kategorii").alias("id"))
    )


def question_editability(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """The form opens for the author of the question only."""
    return requests.join(questions.select("id_pyt", "id_autora"), "id_pyt").select(
        "id_uz", "id_pyt", (F.col("id_uz") == F.col("id_autora")).alias("moze_edytowac")
    )


def first_row(table: DataFrame, key: str) -> DataFrame:
    """The default row: lowest key."""
    return table.orderBy(key).limit(1)
