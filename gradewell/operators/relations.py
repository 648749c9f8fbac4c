"""Associations between tables, all key joins."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.operators.access import granted, with_standing
from gradewell.functions.scalar import privilege_mask
from gradewell.operators.numbering import numbered_by_id
from gradewell.operators.skew import without


def questions_enriched(
    questions: DataFrame, types: DataFrame, categories: DataFrame, quizzes: DataFrame, groups: DataFrame
) -> DataFrame:
    """Question with type, category, quiz and group."""
    return (
        questions.select("id_pyt", "tresc", "id_typu", "id_quizu", "id_kategorii", "pkt", "ukryty")
        .join(types.withColumnRenamed("nazwa", "typ"), "id_typu")
        .join(categories.select("id_kategorii", F.col("nazwa").alias("kategoria")), "id_kategorii")
        .join(quizzes.select("id_quizu", "id_grupy", F.col("nazwa").alias("quiz")), "id_quizu")
        .join(groups.select("id_grupy", F.col("nazwa").alias("grupa")), "id_grupy")
    )


def question_options(questions: DataFrame, templates: DataFrame) -> DataFrame:
    """Question with its template answers; a question without any is kept."""
    return questions.select("id_pyt", "id_quizu", "id_typu").join(
        templates.select("id_pyt", "id_odp_w", "tresc_odp", "poziom_poprawnosci"), "id_pyt", "left"
    )


def question_user_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    return answers.join(questions.select("id_pyt", "id_quizu", "pkt"), "id_pyt")


def quiz_contents(quizzes: DataFrame, questions: DataFrame) -> DataFrame:
    """Quiz with all its questions, hidden ones too."""
    return quizzes.select("id_quizu", F.col("nazwa").alias("quiz")).join(
        questions.select("id_quizu", "id_pyt", "tresc", "ukryty"), "id_quizu"
    )


def group_members(groups: DataFrame, access: DataFrame, users: DataFrame) -> DataFrame:
    """Members of each group with their place in the list; an owner is not removable."""
    members = (
        access.select("id_grupy", "id_uz")
        .join(groups.select("id_grupy", "id_wlasciciela"), "id_grupy")
        .join(users.select("id_uz", "nazwa_uz"), "id_uz")
        .select("id_grupy", "id_uz", "nazwa_uz", (F.col("id_uz") != F.col("id_wlasciciela")).alias("usuwalny"))
    )
    return numbered_by_id(members, "id_uz", by=["id_grupy"])


def member_page(
    visits: DataFrame, groups: DataFrame, access: DataFrame, users: DataFrame, members: DataFrame
) -> DataFrame:
    """Member rows asked for by viewers (id_widza, id_grupy, id_uz), with the remove button's state."""
    standing = with_standing(visits, users, groups, access, user="id_widza")
    may = granted(privilege_mask("deleting_users"), "id_widza")
    return (
        standing.select(*visits.columns, may.alias("_moze"))
        .join(members, ["id_grupy", "id_uz"])
        .select(*visits.columns, "place", "nazwa_uz", (F.col("_moze") & F.col("usuwalny")).alias("przycisk_usun"))
    )


def groups_with_owner(groups: DataFrame, users: DataFrame) -> DataFrame:
    owners = users.select(F.col("id_uz").alias("id_wlasciciela"), F.col("nazwa_uz").alias("wlasciciel"))
    return groups.join(owners, "id_wlasciciela", "left").select(
        "id_grupy", "nazwa", "id_wlasciciela", "wlasciciel"
    )


def ranking_with_user(ranking: DataFrame, users: DataFrame) -> DataFrame:
    return ranking.join(users.select("id_uz", "nazwa_uz"), "id_uz").select(
        "id_grupy", "id_uz", "nazwa_uz", "pkt"
    )


def owned_objects(users: DataFrame, quizzes: DataFrame, groups: DataFrame) -> DataFrame:
    """Quizzes and groups each user owns."""
    owned = quizzes.select("id_wlasciciela", F.lit("quiz").alias("rodzaj"), F.col("id_quizu").alias("id"), "nazwa")
    owned = owned.unionByName(
        groups.select("id_wlasciciela", F.lit("grupa").alias("rodzaj"), F.col("id_grupy").alias("id"), "nazwa")
    )
    return owned.join(
        users.select(F.col("id_uz").alias("id_wlasciciela"), "nazwa_uz"), "id_wlasciciela"
    ).select(F.col("id_wlasciciela").alias("id_uz"), "nazwa_uz", "rodzaj", "id", "nazwa")


def is_enrolled(requests: DataFrame, access: DataFrame) -> DataFrame:
    """Adds a flag: is the user a member of the group."""
    member = access.select("id_uz", "id_grupy", F.lit(True).alias("_zapisany"))
    return requests.join(member, ["id_uz", "id_grupy"], "left").select(
        *requests.columns, F.col("_zapisany").isNotNull().alias("zapisany")
    )


def enrolled(requests: DataFrame, access: DataFrame) -> DataFrame:
    """Only the requests of members."""
    return requests.join(access, ["id_uz", "id_grupy"], "left_semi").select(*requests.columns)


def not_enrolled(requests: DataFrame, access: DataFrame) -> DataFrame:
    """Only the requests of non-members."""
    return requests.join(access, ["id_uz", "id_grupy"], "left_anti").select(*requests.columns)


# Child table, foreign key, parent table, parent key.
FOREIGN_KEYS = [
    ("dostep_grupa", "id_uz", "uzytkownik", "id_uz"),
    ("dostep_grupa", "id_grupy", "grupa_quizowa", "id_grupy"),
    ("dyskusja", "id_quizu", "quiz", "id_quizu"),
    ("dyskusja", "id_uz", "uzytkownik", "id_uz"),
    ("grupa_quizowa", "id_wlasciciela", "uzytkownik", "id_uz"),
    ("odpowiedz_uzytkownika", "id_uz", "uzytkownik", "id_uz"),
    ("odpowiedz_uzytkownika", "id_pyt", "pytanie", "id_pyt"),
    ("odpowiedz_wzorcowa", "id_pyt", "pytanie", "id_pyt"),
    ("podkategoria", "id_nadkategorii", "kategoria", "id_kategorii"),
    ("podkategoria", "id_podkategorii", "kategoria", "id_kategorii"),
    ("pytanie", "id_typu", "typ", "id_typu"),
    ("pytanie", "id_autora", "uzytkownik", "id_uz"),
    ("pytanie", "id_quizu", "quiz", "id_quizu"),
    ("pytanie", "id_kategorii", "kategoria", "id_kategorii"),
    ("quiz", "id_wlasciciela", "uzytkownik", "id_uz"),
    ("quiz", "id_grupy", "grupa_quizowa", "id_grupy"),
    ("ranking", "id_uz", "uzytkownik", "id_uz"),
    ("ranking", "id_grupy", "grupa_quizowa", "id_grupy"),
]


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Foreign-key values without a parent, and how many rows carry each.

    ``tables`` holds every table of ``FOREIGN_KEYS``; one that is not there is a
    ``KeyError``. A child table is read once: its keys are stacked and counted per
    value, so only one row per distinct value reaches the join with the parents'
    keys, however many rows share it.
    """
    children: dict[str, list[tuple[str, str, str]]] = {}
    for child, key, parent, parent_key in FOREIGN_KEYS:
        children.setdefault(child, []).append((key, parent, parent_key))
    counted = []
    for child, keys in children.items():
        pairs = [
            F.struct(F.lit(key).alias("klucz"), F.lit(parent).alias("rodzic"), F.col(key).cast("bigint").alias("wartosc"))
            for key, parent, _ in keys
        ]
        stacked = tables[child].select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*")
        counts = stacked.filter("wartosc IS NOT NULL").groupBy("klucz", "rodzic", "wartosc").agg(F.count("*").alias("wiersze"))
        counted.append(counts.select(F.lit(child).alias("tabela"), "klucz", "rodzic", "wartosc", "wiersze"))
    parents = [
        tables[parent].select(F.lit(parent).alias("rodzic"), F.col(key).cast("bigint").alias("wartosc"))
        for parent, key in sorted({(parent, key) for _, _, parent, key in FOREIGN_KEYS})
    ]
    values, known = reduce(DataFrame.unionByName, counted), reduce(DataFrame.unionByName, parents)
    return without(values, known, ["rodzic", "wartosc"]).select("tabela", "klucz", "wartosc", "wiersze")
