"""Random small tables against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gradewell.operators.sampling import sample_options
from gradewell.operators.scoring import attempt_history, question_scores
from gradewell.schema import QUESTION_TYPES, question_types
from tests.conftest import rows

TIMES = ["2020-01-01 00:00:00.001", "2020-01-01 00:00:00.002"]


def random_world(seed):
    rng = random.Random(seed)
    questions = [(p, rng.choice([1, 2, 3, 7, 8, 11]), rng.choice([0.5, 1.0, 2.5]), p % 3) for p in range(1, 19)]
    templates = []
    for p, *_ in questions:
        for _ in range(rng.randrange(0, 6)):
            templates.append((len(templates) + 1, p, rng.choice("abcd"), rng.choice([0, 0, 40, 100])))
    answers = []
    for user in range(4):
        for time in TIMES:
            for p, *_ in questions:
                for text in rng.sample("abcde", rng.randrange(0, 4)):
                    answers.append((user, p, text, time, rng.random() < 0.5))
    return questions, templates, answers


def frames(spark, questions, templates, answers):
    q = spark.createDataFrame(questions, "id_pyt long, id_typu long, pkt double, id_quizu long")
    t = spark.createDataFrame(templates, "id_odp_w long, id_pyt long, tresc_odp string, poziom_poprawnosci int")
    t = t.withColumn("komentarz", F.lit(None).cast("string"))
    a = spark.createDataFrame(answers, "id_uz long, id_pyt long, tresc_odp string, t string, zaznaczona boolean")
    return q, t, a.withColumn("data_wyslania", F.col("t").cast("timestamp_ntz"))


def plain_score(kind, pkt, given, levels):
    best = {}
    for text, level in levels:
        best[text] = max(level, best.get(text, 0))
    if kind == "multi":
        return pkt if all(tick == (best.get(text, 0) == 100) for text, tick in given) else 0.0
    if kind == "open":
        return pkt * max(best.get(text, 0) for text, _ in given) / 100
    ticked = [text for text, tick in given if tick]
    return pkt * best.get(ticked[0], 0) / 100 if len(ticked) == 1 else 0.0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scores(spark, seed):
    questions, templates, answers = random_world(seed)
    q, t, a = frames(spark, questions, templates, answers)
    shape = {i: "multi" if multi else ("open" if n == 1 else "single") for i, _, n, multi in QUESTION_TYPES}
    want = {}
    for p, typ, pkt, quiz in questions:
        levels = [(text, level) for _, pyt, text, level in templates if pyt == p]
        for user, time in {(u, tm) for u, pyt, _, tm, _ in answers if pyt == p}:
            given = [(text, z) for u, pyt, text, tm, z in answers if (u, pyt, tm) == (user, p, time)]
            want[user, p, time] = (round(plain_score(shape[typ], pkt, given, levels), 6), quiz, pkt)
    scores = question_scores(a, q, question_types(spark), t)
    got = {(r.id_uz, r.id_pyt, str(r.data_wyslania)[:23]): (r.zdobyte_pkt, r.id_quizu, r.max_pkt) for r in scores.collect()}
    assert got == want
    sums = {}
    for (user, _, time), (gained, quiz, pkt) in want.items():
        have = sums.get((user, time, quiz), (0.0, 0.0))
        sums[user, time, quiz] = (round(have[0] + gained, 6), round(have[1] + pkt, 6))
    attempts = attempt_history(scores).collect()
    assert {(r.id_uz, str(r.data_wyslania)[:23], r.id_quizu): (r.zdobyte_pkt, r.max_pkt) for r in attempts} == sums


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_draws(spark, seed):
    questions, templates, answers = random_world(seed)
    q, t, _ = frames(spark, questions, templates, answers)
    sizes = {i: n for i, _, n, _ in QUESTION_TYPES}
    want, failed = [], []
    for user in range(5):
        for p, typ, *_ in questions:
            options = [(w, level) for w, pyt, _, level in templates if pyt == p]
            full = [w for w, level in options if level == 100]
            if not full:
                failed.append((user, p))
                continue
            order = sorted(options, key=lambda o: hashlib.md5(f"s:{user}:{o[0]}".encode()).hexdigest())[: sizes[typ]]
            ids = [w for w, _ in order]
            if not any(level == 100 for _, level in order):
                ids[0] = min(full)
            want += [(user, p, place + 1, w) for place, w in enumerate(ids)]
    draws = spark.range(5).withColumnRenamed("id", "id_uz").withColumn("id_pyt", F.explode(F.sequence(F.lit(1), F.lit(18))))
    drawn, errors = sample_options(draws, q, question_types(spark), t, "s")
    assert rows(drawn, "id_uz", "id_pyt", "place", "id_odp_w") == sorted(want, key=repr)
    assert rows(errors, "id_uz", "id_pyt") == sorted(failed, key=repr)
