"""Table schemas and fixed values of the data model.

Ids are BIGINT. Timestamps may be TIMESTAMP or TIMESTAMP_NTZ; operators never
cast between the two, so each table has a ``schema_of`` with the wanted kind.
"""

from pyspark.sql import types as T

# Fixed values -------------------------------------------------------------
LIMBO_GROUP = 0
PUBLIC_GROUP = 1
LIMBO_USER = 0

RANKS = ["user", "teacher", "moderator", "administrator"]
SUPERUSER_RANKS = ["administrator", "moderator"]

DEFAULT_RIGHTS = "1100000000000000"

PRIVILEGES = {
    "participation_in_quizzes": 1 << 15,
    "participation_in_discussions": 1 << 14,
    "creation_of_quizzes": 1 << 13,
    "editing_and_deleting_quizzes": 1 << 12,
    "editing_and_deleting_discussions": 1 << 11,
    "access_to_group": 0,
}
UNKNOWN_PRIVILEGE = 1

# Texts users see or that are stored
NO_ANSWER = "nil"
COMMENT_PREFIX = "Komentarz: "
NEW_QUESTION_TEXT = "Nowe pytanie z %s"
SCORE_TEXT = "(%s / %s punktów)"
YES, NO = "TAK", "NIE"
BANDS = ["bad-score", "mediocre-score", "good-score"]
BAND_LIMITS = [0.25, 0.75]

# (id_typu, nazwa, liczba_odp, wielokrotnego_wyboru)
QUESTION_TYPES = [
    (1, "jednokrotny 2", 2, False),
    (2, "jednokrotny 3", 3, False),
    (3, "jednokrotny 4", 4, False),
    (4, "jednokrotny 5", 5, False),
    (5, "jednokrotny 6", 6, False),
    (6, "wielokrotny 2", 2, True),
    (7, "wielokrotny 3", 3, True),
    (8, "wielokrotny 4", 4, True),
    (9, "wielokrotny 5", 5, True),
    (10, "wielokrotny 6", 6, True),
    (11, "otwarte", 1, False),
]

# Schemas ------------------------------------------------------------------
_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_FLAG, _REAL = T.BooleanType(), T.DoubleType()
_TIME = "time"

# table -> [(column, type, nullable)]
TABLES = {
    "dostep_grupa": [
        ("id_grupy", _LONG, False),
        ("id_uz", _LONG, False),
        ("prawa_dost", _TEXT, False),
    ],
    "dyskusja": [
        ("id_quizu", _LONG, False),
        ("id_uz", _LONG, False),
        ("tresc", _TEXT, False),
        ("data_wyslania", _TIME, False),
    ],
    "grupa_quizowa": [
        ("id_grupy", _LONG, False),
        ("id_wlasciciela", _LONG, False),
        ("nazwa", _TEXT, False),
        ("na_zaproszenie", _FLAG, False),
        ("haslo", _TEXT, True),
        ("haslo_salt", _TEXT, True),
    ],
    "kategoria": [("id_kategorii", _LONG, False), ("nazwa", _TEXT, False)],
    "odpowiedz_uzytkownika": [
        ("id_odp_u", _LONG, False),
        ("id_uz", _LONG, False),
        ("tresc_odp", _TEXT, False),
        ("id_pyt", _LONG, False),
        ("data_wyslania", _TIME, False),
        ("zaznaczona", _FLAG, False),
    ],
    "odpowiedz_wzorcowa": [
        ("id_odp_w", _LONG, False),
        ("id_pyt", _LONG, False),
        ("tresc_odp", _TEXT, False),
        ("poziom_poprawnosci", _INT, False),
        ("komentarz", _TEXT, True),
        ("ost_modyfikacja", _TIME, True),
    ],
    "podkategoria": [("id_nadkategorii", _LONG, False), ("id_podkategorii", _LONG, False)],
    "pytanie": [
        ("id_pyt", _LONG, False),
        ("tresc", _TEXT, False),
        ("id_typu", _LONG, False),
        ("id_autora", _LONG, False),
        ("pkt", _REAL, False),
        ("id_quizu", _LONG, False),
        ("id_kategorii", _LONG, False),
        ("ukryty", _FLAG, False),
    ],
    "quiz": [
        ("id_quizu", _LONG, False),
        ("id_wlasciciela", _LONG, False),
        ("nazwa", _TEXT, False),
        ("id_grupy", _LONG, False),
        ("limit_podejsc", _INT, True),
        ("limit_czasowy", _TEXT, True),
        ("data_utworzenia", _TIME, False),
        ("ukryty", _FLAG, False),
    ],
    "ranking": [("id_uz", _LONG, False), ("id_grupy", _LONG, False), ("pkt", _REAL, False)],
    "typ": [
        ("id_typu", _LONG, False),
        ("nazwa", _TEXT, False),
        ("liczba_odp", _INT, False),
        ("wielokrotnego_wyboru", _FLAG, False),
    ],
    "uzytkownik": [
        ("id_uz", _LONG, False),
        ("login", _TEXT, False),
        ("haslo", _TEXT, True),
        ("haslo_salt", _TEXT, True),
        ("nazwa_uz", _TEXT, False),
        ("email", _TEXT, False),
        ("ranga", _TEXT, False),
    ],
    # one row per question a user filled in; id_pyt is null for an empty form
    "submissions": [
        ("id_uz", _LONG, False),
        ("id_grupy", _LONG, True),
        ("id_quizu", _LONG, False),
        ("data_wyslania", _TIME, False),
        ("id_pyt", _LONG, True),
        ("chosen", T.ArrayType(_TEXT), True),
        ("open_text", _TEXT, True),
    ],
}


def schema_of(table: str, time_type: T.DataType | None = None) -> T.StructType:
    """The declared schema of ``table``; ``time_type`` defaults to TIMESTAMP_NTZ."""
    time_type = time_type or T.TimestampNTZType()
    return T.StructType(
        [
            T.StructField(name, time_type if kind is _TIME else kind, nullable)
            for name, kind, nullable in TABLES[table]
        ]
    )


def required_columns(table: str) -> list[str]:
    return [name for name, _, nullable in TABLES[table] if not nullable]


def question_types(spark):
    """The seeded question types. Literal rows, so Spark knows how small the table is."""
    rows = ", ".join(f"({i}L, '{name}', {options}, {str(multi).lower()})" for i, name, options, multi in QUESTION_TYPES)
    columns = ", ".join(name for name, _, _ in TABLES["typ"])
    return spark.sql(f"SELECT * FROM VALUES {rows} AS typ({columns})")
