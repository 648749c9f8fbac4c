"""Tables checked while they are written, and published only if they hold.

The rules of a table are counted by observations on its write, so one reading serves all of
them and nothing is read twice. Tables are written beside each other under a new version; a
version counts once its manifest is there, and a table that breaks more rules than it may stops that.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gradewell.operators.quality import group_rules, question_rules, template_rules, user_rules, with_multi_flag
from gradewell.schema import required_columns

MANIFEST = "manifest"


class RulesBroken(Exception):
    """A table breaks a rule more often than it may; nothing is published."""

    def __init__(self, broken: dict[tuple[str, str], int]):
        self.broken = broken
        super().__init__(", ".join(f"{table}.{rule}: {n}" for (table, rule), n in sorted(broken.items())))


def table_rules(table: str, columns: list[str]) -> dict[str, Column]:
    """The rules of a table's rows: required columns are there, and what quality checks ask."""
    own = {
        "uzytkownik": user_rules,
        "grupa_quizowa": group_rules,
        "pytanie": question_rules,
        "odpowiedz_wzorcowa": template_rules,
    }.get(table, dict)()
    absent = [c for c in required_columns(table) if c not in columns]
    if absent:
        raise KeyError(f"{table} has no {', '.join(absent)}")
    return {f"nie_null_{c}": F.col(c).isNull() for c in required_columns(table)} | own


def write_checked(
    tables: Mapping[str, DataFrame], path: str, version: int, allowed: Mapping[tuple[str, str], int] | None = None
) -> DataFrame:
    """Writes ``tables`` under ``path`` as ``version`` and publishes it if they hold.

    ``allowed``: how many rows may break a rule, by (table, rule); none where nothing is said.
    Returns (tabela, regula, wiersze) for every rule that rows break. Raises ``RulesBroken`` with
    the counts, and publishes nothing, where there are more than allowed. Template answers meet
    their questions' types on the way, for which the questions and types must be among the tables.
    A version that is written again replaces what it was.
    """
    allowed = allowed or {}
    counts: dict[tuple[str, str], int] = {}
    spark = next(iter(tables.values())).sparkSession
    for table, df in tables.items():
        rows = df
        if table == "odpowiedz_wzorcowa":
            rows = with_multi_flag(df, tables["pytanie"], tables["typ"])
        rules = table_rules(table, rows.columns)
        seen = Observation(f"{table}-{version}")
        facts = [F.count("*").alias("_rows"), *[F.count_if(broken).alias(name) for name, broken in rules.items()]]
        rows.observe(seen, *facts).select(*df.columns).write.mode("overwrite").parquet(f"{path}/{table}/version={version}")
        counts |= {(table, rule): n for rule, n in seen.get.items()}
    broken = {key: n for key, n in counts.items() if key[1] != "_rows" and n}
    over = {key: n for key, n in broken.items() if n > allowed.get(key, 0)}
    if over:
        raise RulesBroken(over)
    made = [(table, version, counts[table, "_rows"]) for table in tables]
    listed = spark.createDataFrame(made, "tabela string, wersja long, wiersze long")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}/version={version}")
    return spark.createDataFrame([(*key, n) for key, n in sorted(broken.items())], "tabela string, regula string, wiersze long")


def read_published(spark, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the newest published version, or of ``version``."""
    listed = spark.read.parquet(f"{path}/{MANIFEST}")
    if version is None:
        version = listed.agg(F.max("wersja")).first()[0]
    names = [r["tabela"] for r in listed.filter(F.col("wersja") == version).select("tabela").collect()]
    if not names:
        raise KeyError(f"no published version {version}")
    return {name: spark.read.parquet(f"{path}/{name}/version={version}") for name in names}
