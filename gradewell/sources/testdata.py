"""Domain tables read off the star-schema test tables (see FIXTURES.md)."""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.operators.ranking import recompute_ranking
from gradewell.operators.skew import own_shuffle
from gradewell.schema import question_types
from gradewell.sources.shared import sized

#: Tables that grow.
LARGE = ["customer", "supplier", "part", "orders", "lineitem", "events"]
#: Texts of the options of each question, in order.
LETTERS = ["A", "N", "R"]
#: Which questions (id_pyt) are hidden.
HIDDEN = "id_pyt % 11 = 0"


class Domain:
    """Lazily built domain tables over one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        df = self._scan(name)
        return sized(df) if name in LARGE else df

    def _scan(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def uzytkownik(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS id_uz",
            "'u' || c_custkey AS login",
            "c_name AS nazwa_uz",
            """CASE WHEN c_custkey % 89 = 7 THEN 'shared@ex.pl'
                    WHEN c_custkey % 97 = 5 THEN 'broken'
                    ELSE 'u' || c_custkey || '@ex.pl' END AS email""",
            """CASE WHEN c_custkey = 0 THEN 'user'
                    WHEN c_custkey % 50 = 1 THEN 'moderator'
                    WHEN c_custkey % 50 = 2 THEN 'administrator'
                    WHEN c_custkey % 10 = 3 THEN 'teacher'
                    ELSE 'user' END AS ranga""",
        )

    @cached_property
    def grupa_quizowa(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "CAST(n_nationkey AS BIGINT) AS id_grupy",
            "CAST(IF(n_nationkey = 0, 0, n_nationkey * 3 + 1) AS BIGINT) AS id_wlasciciela",
            "n_name AS nazwa",
            "n_nationkey % 5 = 3 AS na_zaproszenie",
            "CASE WHEN n_nationkey % 6 = 4 THEN 'x' WHEN n_nationkey = 13 THEN ' ' END AS haslo",
        )

    @cached_property
    def kategoria(self) -> DataFrame:
        regions, nations = self.raw("region"), self.raw("nation")
        root = regions.agg(F.lit(1).cast("bigint").alias("id_kategorii"), F.lit("Pytania").alias("nazwa"))
        return root.union(
            regions.selectExpr("CAST(2 + r_regionkey AS BIGINT)", "r_name")
        ).union(nations.selectExpr("CAST(10 + n_nationkey AS BIGINT)", "n_name"))

    @cached_property
    def podkategoria(self) -> DataFrame:
        return self.raw("region").selectExpr(
            "CAST(1 AS BIGINT) AS id_nadkategorii", "CAST(2 + r_regionkey AS BIGINT) AS id_podkategorii"
        ).union(
            self.raw("nation").selectExpr(
                "CAST(2 + n_regionkey AS BIGINT)", "CAST(10 + n_nationkey AS BIGINT)"
            )
        )

    @cached_property
    def typ(self) -> DataFrame:
        return question_types(self.spark)

    @cached_property
    def quiz(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS id_quizu",
            "p_partkey % 150 AS id_wlasciciela",
            "p_name AS nazwa",
            "p_partkey % 25 AS id_grupy",
            "nullif(p_size % 5, 0) AS limit_podejsc",
            "IF(p_size % 3 = 0, p_size || ' minutes', NULL) AS limit_czasowy",
            "timestampadd(HOUR, p_partkey, TIMESTAMP_NTZ '1994-01-01') AS data_utworzenia",
            "p_size % 7 = 0 AS ukryty",
        )

    @cached_property
    def pytanie(self) -> DataFrame:
        # Spark gives exploded rows the size of what they come from, and so would broadcast the questions of
        # many quizzes; the size of a join grows with both sides, so the questions meet their types in one
        quizzes = self._scan("part").select(F.col("p_partkey").alias("id_quizu"), F.col("p_name").alias("_nazwa"))
        return self._asked(quizzes).selectExpr(
            "id_pyt",
            "_nazwa || ' ' || k AS tresc",
            "id_typu",
            "id_quizu % 150 AS id_autora",
            "1 + (k % 3) * 0.5D AS pkt",
            "id_quizu",
            "10 + id_pyt % 25 AS id_kategorii",
            f"{HIDDEN} AS ukryty",
        )

    def _asked(self, quizzes: DataFrame) -> DataFrame:
        """A row for each question of the rows' quizzes (id_quizu), with k, id_pyt and id_typu."""
        kinds = self.spark.range(1, 8).selectExpr(
            "CAST(id AS INT) AS k",
            "CAST(CASE WHEN id = 2 THEN 1 WHEN id <= 3 THEN 2 WHEN id <= 5 THEN 7 ELSE 11 END AS BIGINT) AS id_typu",
        )
        numbered = quizzes.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7))))
        return numbered.withColumn("id_pyt", F.col("id_quizu") * 10 + F.col("k")).join(F.broadcast(kinds), "k")

    def _offered(self, asked: DataFrame, texts: Column | None = None) -> DataFrame:
        """A row for each option (i, tresc_odp) of the questions (k, id_pyt, id_quizu), but for doubled ones.
        ``texts``: the options' texts, A, N and R if not given."""
        texts = F.array(*map(F.lit, LETTERS)) if texts is None else texts
        options = asked.select("*", F.posexplode(texts).alias("_pos", "tresc_odp"))
        return options.withColumn("i", F.col("_pos") % len(LETTERS)).filter("NOT (k = 3 AND id_quizu % 13 = 5 AND i = 2)")

    @cached_property
    def odpowiedz_wzorcowa(self) -> DataFrame:
        options = self._offered(self.pytanie.select("id_pyt", "id_quizu", (F.col("id_pyt") % 10).alias("k")))
        regular = options.selectExpr(
            "id_pyt * 10 + i AS id_odp_w",
            "id_pyt",
            "tresc_odp",
            """CASE WHEN k = 5 AND id_quizu % 9 = 4 THEN 0
                    WHEN i = id_pyt % 3 THEN 100
                    WHEN k >= 6 AND i = (id_pyt + 1) % 3 THEN 40
                    ELSE 0 END AS poziom_poprawnosci""",
            "IF(i = 1, 'c' || (id_pyt * 10 + i), NULL) AS komentarz",
            "CAST(NULL AS TIMESTAMP_NTZ) AS ost_modyfikacja",
        )
        doubled = self.pytanie.filter("id_pyt % 10 = 6 AND id_quizu % 40 = 0").selectExpr(
            "id_pyt * 10 + 9",
            "id_pyt",
            "'A'",
            "0",
            "CAST(NULL AS STRING)",
            "CAST(NULL AS TIMESTAMP_NTZ)",
        )
        return regular.union(doubled)

    @cached_property
    def attempts(self) -> DataFrame:
        n_quizzes = self._scan("part").agg(F.count("*").alias("n")).scalar()
        return self.raw("orders").select(
            F.col("o_custkey").alias("id_uz"),
            ((3 * F.col("o_custkey") + F.col("o_orderkey") % 4) % n_quizzes).alias("id_quizu"),
            F.expr("timestampadd(MILLISECOND, o_orderkey, o_orderdate)").alias("data_wyslania"),
            "o_orderkey",
        )

    @cached_property
    def dostep_grupa(self) -> DataFrame:
        rows = (
            self.attempts.join(self.quiz.select("id_quizu", "id_grupy"), "id_quizu")
            .filter("o_orderkey % 5 <> 0 AND id_grupy <> 0 AND id_uz <> 0")
            .select("id_grupy", "id_uz")
            .union(self.uzytkownik.filter("id_uz <> 0").select(F.lit(1).cast("bigint"), "id_uz"))
            .distinct()
        )
        return rows.selectExpr(
            "id_grupy",
            "id_uz",
            """CASE (id_uz + id_grupy) % 6 WHEN 0 THEN '1111100000000000'
                    WHEN 1 THEN '0000000000000000'
                    WHEN 2 THEN '1111100000000001'
                    ELSE '1100000000000000' END AS prawa_dost""",
        )

    @cached_property
    def odpowiedz_uzytkownika(self) -> DataFrame:
        # an attempt stays one short row through all shuffles; its questions and options are made of it afterwards
        times = self.raw("part").groupBy(F.col("p_partkey").alias("id_quizu")).agg(F.count("*").cast("int").alias("_times"))
        marks = self._lines.groupBy("o_orderkey").agg(F.collect_set(F.struct("l_linenumber", "l_returnflag")).alias("_marks"))
        attempts = self.attempts.join(own_shuffle(times, "id_quizu"), "id_quizu").join(marks, "o_orderkey", "left")
        attempts = attempts.withColumn("_nr", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        flags = F.expr("transform(filter(_marks, m -> m.l_linenumber = k AND m.l_returnflag IS NOT NULL), m -> m.l_returnflag)")
        shown = self._asked(attempts).filter(f"NOT ({HIDDEN})").withColumn("_flags", flags)
        # were a quiz in the table twice, each of its questions would be so too, and meet the options of both
        letters = F.array(*map(F.lit, LETTERS))
        letters = F.when(F.col("_times") == 1, letters).otherwise(F.flatten(F.array_repeat(letters, F.col("_times"))))
        is_open = F.col("id_typu") == 11
        texts = F.when(is_open, F.array(F.coalesce(F.array_min("_flags"), F.lit("nil")))).otherwise(letters)
        return self._offered(shown, texts).selectExpr(
            "o_orderkey * 100 + (id_pyt * 10 + i) % 100 AS id_odp_u",
            "id_uz",
            "tresc_odp",
            "id_pyt",
            "data_wyslania",
            "id_typu = 11 OR coalesce(array_contains(_flags, tresc_odp), false) AS zaznaczona",
        )

    @property
    def _lines(self) -> DataFrame:
        """Lines of orders, those of an order in one place."""
        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
        return lines.repartition("o_orderkey")

    @cached_property
    def submissions(self) -> DataFrame:
        entered = self._lines.groupBy("o_orderkey", "l_linenumber").agg(
            F.collect_set("l_returnflag").alias("chosen"), F.min("l_returnflag").alias("open_text")
        )
        return self.attempts.join(entered, "o_orderkey", "left").selectExpr(
            "id_uz",
            "id_quizu % 25 + IF(o_orderkey % 40 = 0, 1, 0) AS id_grupy",
            "id_quizu",
            "data_wyslania",
            "id_quizu * 10 + l_linenumber AS id_pyt",
            "chosen",
            "open_text",
        )

    @cached_property
    def dyskusja(self) -> DataFrame:
        n_quizzes = self._scan("part").agg(F.count("*").alias("n")).scalar()
        return self.raw("events").select(
            (F.col("event_id") % n_quizzes).alias("id_quizu"),
            F.col("user_id").alias("id_uz"),
            F.col("event_type").alias("tresc"),
            F.col("ts").alias("data_wyslania"),
        )

    @cached_property
    def ranking(self) -> DataFrame:
        return recompute_ranking(
            self.odpowiedz_uzytkownika, self.pytanie, self.typ, self.odpowiedz_wzorcowa, self.quiz
        )

    def stored(self, path: str, *names: str, files: int = 1) -> "Domain":
        """Writes the named tables under ``path`` and reads them from there from now on.

        The test tables are one file each; ``files`` gives later scans as many tasks.
        """
        for name in names:
            df = getattr(self, name)
            key = "id_uz" if "id_uz" in df.columns else df.columns[0]
            df.repartition(files, key).write.mode("overwrite").parquet(f"{path}/{name}")
            self.__dict__[name] = self.spark.read.schema(df.schema).parquet(f"{path}/{name}")
        return self

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in names}
