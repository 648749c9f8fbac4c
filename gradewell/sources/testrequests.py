"""Requests and change sets read off the test tables (FIXTURES.md, layer 3).

Every set covers a whole table and holds rows that must be rejected.
"""

from functools import cached_property

from pyspark.sql import DataFrame

from gradewell.sources.testdata import Domain


class Requests(Domain):
    @cached_property
    def _tries(self) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
        return self.attempts.join(orders, "o_orderkey").join(self.quiz.select("id_quizu", "id_grupy"), "id_quizu")

    # listings and checks
    @cached_property
    def wizyty(self) -> DataFrame:
        return self.raw("events").selectExpr("user_id AS id_uz", "event_id % 26 AS id_grupy")

    @cached_property
    def pary(self) -> DataFrame:
        return self.wizyty.union(self.dostep_grupa.select("id_uz", "id_grupy"))

    @cached_property
    def gracze(self) -> DataFrame:
        return self.attempts.select("id_uz", "id_quizu").distinct()

    @cached_property
    def prosby_quiz(self) -> DataFrame:
        return self._tries.selectExpr(
            "o_orderkey AS nr",
            "id_uz",
            "CASE WHEN o_orderpriority LIKE '1%' THEN (id_grupy + 1) % 25 ELSE id_grupy END AS id_grupy",
            "id_quizu",
            """CASE WHEN o_orderstatus = 'O' THEN 'play' WHEN o_orderstatus = 'F' THEN 'edit'
                    WHEN o_orderpriority LIKE '5%' THEN 'delete' ELSE 'create' END AS akcja""",
        )

    @cached_property
    def wypisy(self) -> DataFrame:
        return self._tries.selectExpr(
            "o_orderkey AS nr",
            "CASE WHEN o_orderstatus = 'O' THEN id_uz ELSE CAST(floor(o_totalprice) AS BIGINT) % 100 END AS id_aktora",
            "id_uz",
            "CASE WHEN o_orderpriority LIKE '1%' THEN (id_grupy + 1) % 26 ELSE id_grupy END AS id_grupy",
        )

    @cached_property
    def zawieranie(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            """CASE WHEN l_tax < 0.01 THEN 99 WHEN l_discount < 0.01 THEN (l_partkey + 1) % 25
                    ELSE l_partkey % 25 END AS id_grupy""",
            "CASE WHEN l_quantity > 48 THEN -1 ELSE l_partkey END AS id_quizu",
            """CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN NULL WHEN l_discount > 0.08 THEN -5
                    WHEN l_tax > 0.06 THEN l_partkey * 10 + 10 + l_linenumber
                    ELSE l_partkey * 10 + l_linenumber END AS id_pyt""",
        )

    @cached_property
    def edycje_profilu(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_custkey AS id_aktora",
            "CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE o_orderkey % 2000 END AS id_uz",
        )

    @cached_property
    def propozycje(self) -> DataFrame:
        return self.raw("lineitem").selectExpr("l_partkey AS id_quizu", "l_suppkey AS id_uz").distinct()

    @cached_property
    def edycje_pytan(self) -> DataFrame:
        return self.raw("lineitem").selectExpr("l_suppkey AS id_uz", "l_partkey * 10 + l_linenumber AS id_pyt")

    @cached_property
    def szukane(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .selectExpr("l_partkey * 10 + l_linenumber AS id_pyt", "l_returnflag AS tresc_odp")
            .distinct()
        )

    @cached_property
    def klucze(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "CASE WHEN l_quantity > 49 THEN -l_partkey - 1 ELSE l_partkey END AS id_quizu"
        )

    # change sets
    @cached_property
    def zmiany_widocznosci(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS nr",
            "CASE WHEN o_orderstatus = 'P' THEN -1 - o_custkey ELSE o_custkey END AS id_quizu",
            "o_orderpriority < '3' AS ukryty",
        )

    @cached_property
    def przelaczenia(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "CASE WHEN l_quantity > 49 THEN -1 - l_partkey ELSE l_partkey * 10 + l_linenumber END AS id_pyt"
        )

    @cached_property
    def zmiany_pytan(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS nr",
            "o_custkey * 10 + 1 + o_orderkey % 8 AS id_pyt",
            """CASE WHEN o_orderstatus = 'F' THEN o_orderpriority
                    WHEN o_orderstatus = 'P' AND o_orderpriority LIKE '5%' THEN ' ' END AS tresc""",
            """CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 3
                         WHEN o_orderpriority LIKE '2%' THEN 7 END AS BIGINT) AS id_typu""",
            "CAST(CASE WHEN o_totalprice < 5000 THEN -1 WHEN o_totalprice > 300000 THEN 2.5 END AS DOUBLE) AS pkt",
            "CAST(CASE WHEN o_orderpriority LIKE '4%' THEN 1 END AS BIGINT) AS id_kategorii",
        )

    @cached_property
    def zmiany_odpowiedzi(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS nr",
            "CASE o_orderstatus WHEN 'O' THEN 'update' WHEN 'F' THEN 'create' ELSE 'delete' END AS op",
            "o_custkey * 10 + 1 + o_orderkey % 8 AS id_pyt",
            """CASE left(o_orderpriority, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'N' WHEN '3' THEN 'R'
                    WHEN '4' THEN 'X' ELSE '' END AS tresc_odp""",
            """CASE WHEN o_totalprice > 400000 THEN 150 WHEN o_totalprice > 200000 THEN 100
                    WHEN o_totalprice > 100000 THEN 40 ELSE 0 END AS poziom_poprawnosci""",
            "o_orderpriority AS komentarz",
            "o_orderdate AS kiedy",
        )

    @cached_property
    def zmiany_wlascicieli(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS nr",
            "CASE WHEN o_orderstatus = 'P' THEN -1 - o_custkey ELSE o_custkey END AS id_quizu",
            "o_orderkey % 150 AS id_wlasciciela",
        )

    @cached_property
    def przeniesienia(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS nr",
            "CASE WHEN o_orderstatus = 'P' THEN -1 - o_custkey ELSE o_custkey END AS id_quizu",
            "o_orderkey % 26 AS id_grupy",
        )

    @cached_property
    def nowe_quizy(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS nr",
            "o_custkey AS id_wlasciciela",
            "o_orderpriority AS nazwa",
            "CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 25 END AS id_grupy",
            "o_orderdate AS kiedy",
        )

    @cached_property
    def nowe_pytania(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS nr", "o_custkey AS id_quizu", "o_custkey AS id_autora", "o_orderdate AS kiedy"
        )

    @cached_property
    def nowe_grupy(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS nr",
            "c_custkey AS id_wlasciciela",
            """CASE WHEN c_acctbal < 0 THEN ' ' WHEN c_acctbal > 9000 THEN 'NATION_3'
                    WHEN c_acctbal > 8000 THEN repeat(c_name, 4)
                    ELSE c_mktsegment || ' ' || c_nationkey END AS nazwa""",
            "CASE WHEN c_acctbal > 5000 THEN true WHEN c_acctbal > 3000 THEN false END AS na_zaproszenie",
            "CAST(NULL AS STRING) AS haslo",
        )

    @cached_property
    def nowi_uzytkownicy(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS nr",
            "CASE WHEN o_orderpriority LIKE '1%' THEN 'u' || o_custkey ELSE 'n' || (o_orderkey % 9000) END AS login",
            """CASE WHEN o_orderpriority LIKE '2%' THEN '' WHEN o_orderpriority LIKE '3%' THEN repeat('dlugi', 8)
                    ELSE 'Nowy ' || o_orderkey END AS nazwa_uz""",
            """CASE WHEN o_orderstatus = 'P' THEN 'zly' WHEN o_orderkey % 17 = 3 THEN 'shared@ex.pl'
                    ELSE 'n' || (o_orderkey % 7000) || '@ex.pl' END AS email""",
        )

    @cached_property
    def quizy_do_usuniecia(self) -> DataFrame:
        return self.raw("part").filter("p_brand IN ('Brand#1', 'Brand#17')").selectExpr("p_partkey AS id_quizu")

    @cached_property
    def pytania_do_usuniecia(self) -> DataFrame:
        return self.raw("lineitem").filter("l_quantity > 49").selectExpr("l_partkey * 10 + l_linenumber AS id_pyt")

    @cached_property
    def uzytkownicy_do_usuniecia(self) -> DataFrame:
        return self.raw("customer").filter("c_acctbal < 0 OR c_custkey = 0").selectExpr("c_custkey AS id_uz")

    @cached_property
    def zmiany_profili(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS nr",
            """CASE WHEN o_orderstatus = 'P' AND o_orderpriority LIKE '5%' THEN -1 - o_custkey
                    ELSE o_custkey END AS id_uz""",
            "CASE WHEN o_orderpriority LIKE '1%' THEN 'Nowy ' || (o_orderkey % 300) END AS nazwa_uz",
            """CASE WHEN o_orderpriority LIKE '2%' THEN 'login_za_dlugi_na_pole'
                    WHEN o_orderpriority LIKE '3%' THEN 'n' || o_orderkey END AS login""",
            """CASE WHEN o_orderpriority NOT LIKE '4%' THEN NULL WHEN o_orderstatus = 'F' THEN 'zly'
                    WHEN o_orderstatus = 'O' THEN 'u' || (o_custkey + 1) || '@ex.pl'
                    ELSE 'nowy' || o_orderkey || '@ex.pl' END AS email""",
        )
