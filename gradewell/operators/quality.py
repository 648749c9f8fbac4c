"""Data-quality checks. Each gives (tabela, regula, klucz) rows, one per violation."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.scalar import blank, email_ok
from gradewell.operators.relations import orphans  # noqa: F401  (the sixth check)
from gradewell.schema import required_columns


def problems(rules: dict[str, Column]) -> Column:
    """Array of the names of the rules a row breaks. A null condition is no violation."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def _too_long(column: str, limit: int) -> Column:
    return F.length(column) > limit


def user_rules() -> dict[str, Column]:
    return {
        "email_pusty": blank("email"),
        "email_za_dlugi": _too_long("email", 60),
        "email_format": ~email_ok("email"),
        "nazwa_uz_pusta": blank("nazwa_uz"),
        "nazwa_uz_za_dluga": _too_long("nazwa_uz", 30),
        "login_pusty": blank("login"),
        "login_za_dlugi": _too_long("login", 15),
    }


def group_rules() -> dict[str, Column]:
    return {
        "wlasciciel_pusty": F.col("id_wlasciciela").isNull(),
        "nazwa_pusta": blank("nazwa"),
        "nazwa_za_dluga": _too_long("nazwa", 60),
    }


def question_rules() -> dict[str, Column]:
    return {
        "tresc_pusta": blank("tresc"),
        "pkt_puste": F.col("pkt").isNull(),
        "pkt_ujemne": F.col("pkt") < 0,
    }


def template_rules(multi="wielokrotnego_wyboru") -> dict[str, Column]:
    level = F.col("poziom_poprawnosci")
    return {
        "tresc_odp_pusta": blank("tresc_odp"),
        "poziom_pusty": level.isNull(),
        "poziom_poza_zakresem": ~level.between(0, 100),
        "poziom_wielokrotny": F.col(multi) & ~level.isin(0, 100),
    }


def violations(df: DataFrame, table: str, key: str, rules: dict[str, Column]) -> DataFrame:
    return df.select(
        F.lit(table).alias("tabela"),
        F.explode(problems(rules)).alias("regula"),
        F.col(key).cast("string").alias("klucz"),
    )


def check_users(users: DataFrame) -> DataFrame:
    return violations(users, "uzytkownik", "id_uz", user_rules())


def check_groups(groups: DataFrame) -> DataFrame:
    return violations(groups, "grupa_quizowa", "id_grupy", group_rules())


def check_questions(questions: DataFrame) -> DataFrame:
    return violations(questions, "pytanie", "id_pyt", question_rules())


def check_templates(templates: DataFrame, questions: DataFrame, types: DataFrame) -> DataFrame:
    typed = with_multi_flag(templates, questions, types)
    return violations(typed, "odpowiedz_wzorcowa", "id_odp_w", template_rules())


def with_multi_flag(templates: DataFrame, questions: DataFrame, types: DataFrame) -> DataFrame:
    shape = questions.select("id_pyt", "id_typu").join(
        types.select("id_typu", "wielokrotnego_wyboru"), "id_typu"
    )
    return templates.join(shape.select("id_pyt", "wielokrotnego_wyboru"), "id_pyt", "left")


# Columns that must be unique.
UNIQUE = [
    ("uzytkownik", ["email"]),
    ("uzytkownik", ["login"]),
    ("uzytkownik", ["nazwa_uz"]),
    ("grupa_quizowa", ["nazwa"]),
    ("kategoria", ["nazwa"]),
    ("typ", ["nazwa"]),
    ("podkategoria", ["id_podkategorii"]),
    ("dostep_grupa", ["id_grupy", "id_uz"]),
    ("ranking", ["id_uz", "id_grupy"]),
]


def check_unique(tables: dict[str, DataFrame]) -> DataFrame:
    """Values that occur more than once; ``klucz`` is the value as text.

    ``tables`` holds every table of ``UNIQUE``; one that is not there is a ``KeyError``.
    As in SQL, a value with a null in it is no duplicate.
    """
    found = [
        tables[table]
        .dropna(subset=columns)
        .groupBy(*columns)
        .agg(F.count("*").alias("_n"))
        .filter("_n > 1")
        .select(
            F.lit(table).alias("tabela"),
            F.lit("unikalne_" + "_".join(columns)).alias("regula"),
            F.concat_ws(",", *[F.col(c).cast("string") for c in columns]).alias("klucz"),
        )
        for table, columns in UNIQUE
    ]
    return reduce(DataFrame.unionByName, found)


def check_not_null(tables: dict[str, DataFrame], partial: tuple[str, ...] = ()) -> DataFrame:
    """Nulls in NOT NULL columns, counted per column: ``klucz`` is the column name.

    One pass per table. The count of each column is taken map-side, so the
    result stays one row per broken column. A column that is not there is a ``KeyError``,
    unless its table is named as ``partial`` (a change set that sets some columns).
    """
    found = []
    for table, df in tables.items():
        columns = required_columns(table)
        absent = [c for c in columns if c not in df.columns]
        if absent and table not in partial:
            raise KeyError(f"{table} has no {', '.join(absent)}")
        columns = [c for c in columns if c not in absent]
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        pairs = F.array(*[F.struct(F.lit(c).alias("klucz"), F.col(c).alias("wiersze")) for c in columns])
        found.append(
            counts.select(F.explode(pairs).alias("_p"))
            .filter("_p.wiersze > 0")
            .select(F.lit(table).alias("tabela"), F.lit("nie_null").alias("regula"), "_p.klucz", "_p.wiersze")
        )
    return reduce(DataFrame.unionByName, found)
