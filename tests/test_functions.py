import pytest
from pyspark.sql import functions as F

from gradewell.functions import scalar as S
from gradewell.operators.hierarchy import category_closure
from tests.conftest import rows


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "score, top, band",
    [(0.0, 4.0, "bad-score"), (1.0, 4.0, "mediocre-score"), (2.9, 4.0, "mediocre-score"), (3.0, 4.0, "good-score"), (0.0, 0.0, "good-score")],
)
def test_bands(spark, score, top, band):
    assert one(spark, S.score_band("s", "m"), s=score, m=top) == band


@pytest.mark.parametrize("text, value", [("12abc", 12), (" -3", -3), ("x1", 0), ("", 0), ("4.9", 4), ("+7", 7)])
def test_leading_int(spark, text, value):
    assert one(spark, S.leading_int("t"), t=text) == value


@pytest.mark.parametrize("text, empty", [("", True), (" \t\n", True), ("a", False), (" a ", False)])
def test_blank(spark, text, empty):
    assert one(spark, S.blank("t"), t=text) is empty
    assert one(spark, S.present("t"), t=text) is not empty


def test_null_is_blank(spark):
    assert spark.range(1).select(S.blank(F.lit(None).cast("string")).alias("x")).first().x is True


@pytest.mark.parametrize(
    "text, ok", [("a@b.pl", True), ("xx a.b+c@d-e.com yy", True), ("a@b", False), ("broken", False), ("a@b.c", False)]
)
def test_email(spark, text, ok):
    assert one(spark, S.email_ok("t"), t=text) is ok


def test_bits(spark):
    assert one(spark, S.bits_to_int("b"), b="1100000000000000") == (1 << 15) | (1 << 14)
    assert one(spark, S.has_bits("b", 0), b="0000000000000000") is True
    null = spark.range(1).select(S.has_bits(F.lit(None).cast("string"), 0).alias("x")).first().x
    assert null is False


def test_time_text(spark):
    t = "2013-09-09 22:10:12.345"
    assert one(spark, S.format_time(F.lit(t).cast("timestamp_ntz"))) == t
    assert str(one(spark, S.parse_time("t", zoned=False), t=t)) == "2013-09-09 22:10:12.345000"
    assert one(spark, S.parse_time("t"), t="never") is None


def test_strip_and_slots(spark):
    assert one(spark, S.strip("t"), t="\t a b \r\n") == "a b"
    assert (one(spark, S.block_of("i", 4), i=11), one(spark, S.slot_of("i", 4), i=11)) == (2, 3)


def test_deep_category_chain(spark):
    depth = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(depth)], "id_nadkategorii long, id_podkategorii long")
    want = [(a, b, b - a) for a in range(depth + 1) for b in range(a + 1, depth + 1)]
    assert rows(category_closure(edges)) == sorted(want, key=repr)


def test_closure_of_a_wide_tree_is_whole(spark):
    """More rows than a driver would hold."""
    wide = spark.range(1, 600_001).selectExpr("(id - 1) DIV 1000 AS id_nadkategorii", "id AS id_podkategorii")
    got = category_closure(wide).groupBy("glebokosc").count()
    counts = {r.glebokosc: r["count"] for r in got.collect()}
    # the first thousand nodes hang on the root, all others have a grandparent
    assert counts[1] == 600_000 and counts[2] == 599_000 and sum(counts.values()) > 1_000_000
