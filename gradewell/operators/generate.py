"""Quiz sets built from question blocks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.operators.numbering import numbered


def generate_quiz_set(
    blocks: DataFrame,
    name: str,
    quizzes: int,
    answers: int,
    type_id: int,
    at: Column,
    first_quiz_id: int = 1,
    first_question_id: int | Column = 1,
    first_template_id: int | Column = 1,
    owner: int = 1,
    group: int = 1,
    category: int = 1,
) -> dict[str, DataFrame]:
    """Quizzes, questions and template answers of one set.

    ``name`` is the quiz name, with ``%d`` where its number goes. ``blocks`` come
    from ``question_blocks``, their sources being numbers or sortable text. Question ``i`` goes to quiz ``i mod quizzes``. Each question
    gets ``answers`` template answers, the first at level 100; one that the
    block does not have is an empty text.
    """
    spark = blocks.sparkSession
    numbers = spark.range(quizzes)
    quiz = numbers.select(
        (F.col("id") + first_quiz_id).alias("id_quizu"),
        F.lit(owner).cast("bigint").alias("id_wlasciciela"),
        F.format_string(name, *([F.col("id") + 1] if "%d" in name else [])).alias("nazwa"),
        F.lit(group).cast("bigint").alias("id_grupy"),
        F.lit(None).cast("int").alias("limit_podejsc"),
        F.lit(None).cast("string").alias("limit_czasowy"),
        at.alias("data_utworzenia"),
        F.lit(False).alias("ukryty"),
    )
    # sources first, then runs of blocks inside a source
    indexed = numbered(blocks, [F.col("zrodlo"), F.col("blok")], name="_i").withColumn("_i", F.col("_i") - 1)
    question_id = F.col("_i") + first_question_id
    pytanie = indexed.select(
        question_id.alias("id_pyt"),
        F.coalesce("pytanie", F.lit("")).alias("tresc"),
        F.lit(type_id).cast("bigint").alias("id_typu"),
        F.lit(owner).cast("bigint").alias("id_autora"),
        F.lit(1.0).alias("pkt"),
        (F.pmod("_i", F.lit(quizzes)) + first_quiz_id).alias("id_quizu"),
        F.lit(category).cast("bigint").alias("id_kategorii"),
        F.lit(False).alias("ukryty"),
    )
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(answers - 1)),
        lambda slot: F.coalesce(F.get("odpowiedzi", slot), F.lit("")),
    )
    odpowiedz = indexed.select("_i", F.posexplode(slots).alias("_slot", "tresc_odp")).select(
        (F.col("_i") * answers + F.col("_slot") + first_template_id).alias("id_odp_w"),
        question_id.alias("id_pyt"),
        "tresc_odp",
        F.when(F.col("_slot") == 0, 100).otherwise(0).alias("poziom_poprawnosci"),
        F.lit(None).cast("string").alias("komentarz"),
    )
    return {"quiz": quiz, "pytanie": pytanie, "odpowiedz_wzorcowa": odpowiedz}


def generate_chain(
    sets: dict[str, dict], at: Column, first_quiz_id: int = 1, first_question_id: int = 1, first_template_id: int = 1, **owner: int
) -> dict[str, dict[str, DataFrame]]:
    """Several sets one after another: the ids of each go on where those of the one before it end.

    ``sets``: by name, the arguments of ``generate_quiz_set`` that are its own: blocks, name,
    quizzes, answers and type_id. The questions of earlier sets are counted where a plan runs.
    """
    out, quiz_id, question_id, template_id = {}, first_quiz_id, F.lit(first_question_id), F.lit(first_template_id)
    for name, own in sets.items():
        out[name] = generate_quiz_set(
            **own, at=at, first_quiz_id=quiz_id, first_question_id=question_id, first_template_id=template_id, **owner
        )
        made = own["blocks"].agg(F.count("*").alias("_n")).scalar()
        quiz_id, question_id = quiz_id + own["quizzes"], question_id + made
        template_id = template_id + made * own["answers"]
    return out


def generation_summary(sets: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Number of quizzes and questions made, per set."""
    rows = None
    for name, tables in sets.items():
        one = (
            tables["quiz"].select(F.lit(1).alias("q"), F.lit(0).alias("p"))
            .unionByName(tables["pytanie"].select(F.lit(0).alias("q"), F.lit(1).alias("p")))
            .agg(F.sum("q").alias("quizy"), F.sum("p").alias("pytania"))
            .select(F.lit(name).alias("zestaw"), "quizy", "pytania")
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows
