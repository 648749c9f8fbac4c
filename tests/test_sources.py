import pytest
from pyspark.sql import functions as F

from gradewell.operators.generate import generate_quiz_set, generation_summary
from gradewell.schema import TABLES, question_types, schema_of
from gradewell.sources import line_blocks as LB
from gradewell.sources import tables
from tests.conftest import rows

FIVE = [f"pytanie {q}" if a == 0 else f"odp {q}.{a}" for q in range(4) for a in range(5)][:-1]


@pytest.fixture(scope="module")
def text_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("text") / "pytania.txt"
    path.write_text("\n".join(f"  {line}\t" for line in FIVE) + "\n", encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("stride", [4, 5])
def test_blocks_by_stride(spark, text_file, stride):
    got = {r.blok: (r.pytanie, r.odpowiedzi) for r in LB.read_question_blocks(spark, text_file, stride).collect()}
    want = {
        i // stride: (FIVE[i], FIVE[i + 1 : i + stride]) for i in range(0, len(FIVE), stride)
    }
    assert got == want


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f"wiersz {i} " + "x" * (i % 37) for i in range(5000)]
    for name in ("a", "b"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = LB.file_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = df.groupBy("zrodlo").agg(F.sort_array(F.collect_list(F.struct("nr_linii", "linia"))).alias("l")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 2
    for r in got:
        assert [(x.nr_linii, x.linia) for x in r.l] == list(enumerate(lines))


def test_generated_set(spark, text_file):
    blocks = LB.read_question_blocks(spark, text_file, 5)
    at = F.lit("2013-01-01").cast("timestamp_ntz")
    made = generate_quiz_set(
        blocks, "zestaw %d", quizzes=3, answers=4, type_id=3, at=at, first_quiz_id=3, first_question_id=4
    )
    assert rows(made["quiz"], "id_quizu", "nazwa") == [(3, "zestaw 1"), (4, "zestaw 2"), (5, "zestaw 3")]
    assert rows(made["pytanie"], "id_pyt", "tresc", "id_quizu") == [
        (4, "pytanie 0", 3), (5, "pytanie 1", 4), (6, "pytanie 2", 5), (7, "pytanie 3", 3),
    ]
    last = made["odpowiedz_wzorcowa"].filter("id_pyt = 7")
    assert rows(last, "tresc_odp", "poziom_poprawnosci") == [("", 0), ("odp 3.1", 100), ("odp 3.2", 0), ("odp 3.3", 0)]
    assert rows(generation_summary({"m": made})) == [("m", 3, 4)]
    one = generate_quiz_set(blocks, "Jeden", quizzes=1, answers=4, type_id=3, at=at)
    assert rows(one["quiz"], "id_quizu", "nazwa") == [(1, "Jeden")]
    assert rows(one["pytanie"].select("id_quizu").distinct()) == [(1,)]


def test_tables_round_trip(spark, domain, tmp_path):
    picked = {"quiz": domain.quiz, "odpowiedz_uzytkownika": domain.odpowiedz_uzytkownika.filter("id_uz < 5")}
    tables.write_tables(picked, str(tmp_path))
    back = tables.load_tables(spark, str(tmp_path), list(picked))
    for name, df in picked.items():
        assert back[name].schema.names[: len(TABLES[name])] == schema_of(name).names
        assert rows(back[name].select(*df.columns)) == rows(df)
    plan = back["odpowiedz_uzytkownika"]._jdf.queryExecution().toString()
    assert "quiz" not in plan.split("Location")[-1]


def test_submissions_batch_and_stream(spark, domain, tmp_path):
    path = str(tmp_path / "in")
    domain.submissions.write.parquet(path)
    assert tables.read_submissions(spark, path).count() == domain.submissions.count()
    assert tables.read_submissions(spark, path, stream=True, files_per_trigger=1).isStreaming


def test_seed_types(spark):
    types = question_types(spark)
    assert types.count() == 11
    assert dict(types.dtypes) == {"id_typu": "bigint", "nazwa": "string", "liczba_odp": "int", "wielokrotnego_wyboru": "boolean"}
