"""Look-ups on tables laid out by key, and bitmaps of members."""

import random

import pytest
from pyspark.sql import functions as F

from gradewell.operators import access as AC
from gradewell.operators import bitmaps as BM
from gradewell.operators import catalog as CA
from gradewell.operators import relations as RE
from gradewell.sources import indexed as IX
from tests.conftest import rows

N = 400_000


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Hashed keys, in many small row groups."""
    path = str(tmp_path_factory.mktemp("indexed") / "t")
    df = spark.range(N).select(F.xxhash64("id").alias("k"), F.col("id"), F.repeat(F.md5(F.col("id").cast("string")), 3).alias("text"))
    IX.write_indexed(df, path, "k", group_bytes=64 << 10, keys_in_group=2000)
    return path


def scanned(df):
    """Rows that the scan of ``df`` gave on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_a_lookup_reads_few_row_groups(spark, table):
    keys = spark.range(0, N, N // 1000).select(F.xxhash64("id").alias("k"))
    some = spark.range(0, N, N // 20).select(F.xxhash64("id").alias("k"))
    none = spark.range(N, N + 50).select(F.xxhash64("id").alias("k"))
    whole = scanned(spark.read.parquet(table))
    assert whole == N
    few, absent = (scanned(IX.narrowed(spark.read.parquet(table), k, "k")) for k in (some, none))
    assert few < N / 5 and absent < N / 10
    found, missing = IX.lookup_indexed(spark, keys.unionByName(none), table, "k")
    assert found.count() == 1000 and missing.count() == 50
    over = IX.lookup_indexed(spark, keys, table, "k", most=100)[0]  # beyond the bound, as a join
    assert over.exceptAll(found).isEmpty() and over.count() == 1000
    assert IX.lookup_indexed(spark, keys.limit(0), table, "k")[0].isEmpty()


def test_templates(spark, domain, tmp_path):
    path = str(tmp_path / "w")
    IX.write_indexed(domain.odpowiedz_wzorcowa, path, "id_pyt")
    asked = domain.odpowiedz_wzorcowa.filter("id_pyt % 50 = 1").select("id_pyt", "tresc_odp").distinct()
    assert rows(IX.template_lookup_indexed(spark, asked, path)) == rows(CA.template_lookup(asked, domain.odpowiedz_wzorcowa))


def test_bitmaps_equal_the_joins(spark):
    rng = random.Random(8)
    ids = [0, -1, -32768, -40000, 1, 32767, 32768, 32769, 65536, 10**12] + [rng.randrange(200_000) for _ in range(400)]
    pairs = {(g, u) for u in ids for g in range(4) if rng.random() < 0.4}
    masks = ["1100000000000000", "0000000000000000", "1111100000000000", None]
    access = spark.createDataFrame([(g, u, rng.choice(masks)) for g, u in sorted(pairs)] + [(None, 1, masks[0]), (1, None, masks[0])], "id_grupy long, id_uz long, prawa_dost string")
    users = spark.createDataFrame([(u, rng.choice(["user", "moderator", None])) for u in sorted(set(ids))], "id_uz long, ranga string")
    groups = spark.createDataFrame([(g, rng.choice(ids)) for g in range(5)], "id_grupy long, id_wlasciciela long")
    asked = [(u, g) for u in sorted(set(ids)) + [5_000_000] for g in range(6)] + [(None, 1), (1, None), (None, None)]
    requests = spark.createDataFrame(asked, "id_uz long, id_grupy long")
    members = BM.right_bitmaps(access)
    assert rows(BM.is_enrolled(requests, members)) == rows(RE.is_enrolled(requests, access))
    assert rows(BM.not_enrolled(requests, members)) == rows(RE.not_enrolled(requests, access))
    who = {"users": users, "groups": groups, "access": access}
    for names in (("participation_in_quizzes",), ("creation_of_quizzes", "participation_in_quizzes"), ("access_to_group",), ("what",)):
        assert rows(BM.has_privileges(requests, *names, **who)) == rows(AC.has_privileges(requests, *names, **who))
    assert members.agg(F.max(F.length("czlonkowie")), F.sum(F.bitmap_count("czlonkowie"))).first()[:] == (4096, len(pairs))
    none = BM.right_bitmaps(access.limit(0))
    assert BM.is_enrolled(requests, none).filter("zapisany").isEmpty()
