"""Tables that are checked while they are written."""

import pytest
from pyspark.sql import functions as F

from gradewell.operators import publish as PU
from gradewell.operators import quality as QU
from gradewell.sources.testrequests import Requests
from tests.conftest import SF_SMALL, rows

NAMES = ("uzytkownik", "grupa_quizowa", "typ", "pytanie", "quiz", "odpowiedz_wzorcowa")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = Requests(spark, SF_SMALL).stored(str(tmp_path_factory.mktemp("publish")), *NAMES)
    found = d.tables(*NAMES)
    third = F.col("id_pyt") % 3 == 0
    found["pytanie"] = found["pytanie"].withColumns(
        {"tresc": F.when(third, " ").otherwise(F.col("tresc")), "pkt": F.when(F.col("id_pyt") % 5 > 0, F.col("pkt") - 1.2)}
    )
    found["odpowiedz_wzorcowa"] = found["odpowiedz_wzorcowa"].withColumn("poziom_poprawnosci", F.col("poziom_poprawnosci") + F.when(third, 7).otherwise(0))
    return found


def allowed(tables):
    return {(t, r): 1 << 60 for t, df in tables.items() for r in PU.table_rules(t, [*df.columns, "wielokrotnego_wyboru"])}


def test_counts_are_those_of_the_checks(spark, tables, tmp_path):
    report = PU.write_checked(tables, str(tmp_path), 1, allowed(tables))
    checks = [
        QU.check_users(tables["uzytkownik"]), QU.check_groups(tables["grupa_quizowa"]), QU.check_questions(tables["pytanie"]),
        QU.check_templates(tables["odpowiedz_wzorcowa"], tables["pytanie"], tables["typ"]),
    ]
    want = [r for c in checks for r in rows(c.groupBy("tabela", "regula").count())]
    nulls = QU.check_not_null(tables).select("tabela", F.concat(F.lit("nie_null_"), "klucz").alias("regula"), "wiersze")
    assert rows(report) == sorted(want + rows(nulls), key=repr)
    back = PU.read_published(spark, str(tmp_path))
    assert all(rows(back[name]) == rows(df) for name, df in tables.items())


def test_one_scan_a_table(tables, tmp_path):
    rules = PU.table_rules("pytanie", tables["pytanie"].columns)
    observed = tables["pytanie"].observe("x", *[F.count_if(c).alias(n) for n, c in rules.items()])
    plan = observed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "CollectMetrics" in plan


def test_a_broken_rule_stops_publishing(spark, tables, tmp_path):
    path = str(tmp_path)
    PU.write_checked({"typ": tables["typ"]}, path, 1)
    with pytest.raises(PU.RulesBroken) as error:
        PU.write_checked({"typ": tables["typ"], "pytanie": tables["pytanie"]}, path, 2)
    assert ("pytanie", "tresc_pusta") in error.value.broken
    assert set(PU.read_published(spark, path)) == {"typ"}
    n = error.value.broken["pytanie", "tresc_pusta"]
    limits = dict.fromkeys(error.value.broken, 1 << 60)
    for most in (n - 1, n):
        limits["pytanie", "tresc_pusta"] = most
        if most < n:
            with pytest.raises(PU.RulesBroken):
                PU.write_checked({"pytanie": tables["pytanie"]}, path, 2, limits)
    PU.write_checked({"pytanie": tables["pytanie"]}, path, 2, limits)
    PU.write_checked({"pytanie": tables["pytanie"].filter("pkt > 0 AND tresc <> ' '")}, path, 3)
    assert PU.read_published(spark, path)["pytanie"].filter("tresc = ' '").isEmpty()
    assert not PU.read_published(spark, path, 2)["pytanie"].filter("tresc = ' '").isEmpty()
    with pytest.raises(KeyError):
        PU.read_published(spark, path, 9)
    with pytest.raises(KeyError):
        PU.write_checked({"pytanie": tables["pytanie"].drop("tresc")}, path, 4)


def test_empty_tables(spark, tables, tmp_path):
    none = {name: df.limit(0) for name, df in tables.items()}
    assert PU.write_checked(none, str(tmp_path), 1).isEmpty()
    assert all(df.isEmpty() for df in PU.read_published(spark, str(tmp_path)).values())
