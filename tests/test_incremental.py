"""What is kept by changes against what is worked out anew, batch by batch."""

import random

from gradewell.operators import incremental as IN
from gradewell.operators.counts import active_quiz_counts, member_counts
from gradewell.operators.ranking import ranking_from_attempts
from gradewell.sources.shared import stored
from tests.conftest import rows

CHANGE = "id_uz long, id_quizu long, data_wyslania long, zdobyte_pkt double, zmiana int"


def test_ranking_after_twenty_batches(spark, tmp_path):
    rng, path, now = random.Random(4), str(tmp_path), {}
    quizzes = spark.createDataFrame([(q, q % 4) for q in range(8)], "id_quizu long, id_grupy long")
    best = spark.createDataFrame([], "id_uz long, id_quizu long, best double")
    ranking = spark.createDataFrame([], "id_uz long, id_grupy long, pkt double, quizy long")
    for number in range(20):
        batch = []
        for key in rng.sample(sorted(now), len(now) // 3):
            batch.append((*key, now.pop(key), -1))
        for k in range(rng.randrange(1, 25)):
            key = (rng.randrange(12), rng.randrange(8), 100 * number + k)
            now[key] = rng.randrange(11) / 2
            batch.append((*key, now[key], 1))
            if rng.random() < 0.15:  # comes and goes in one batch
                batch.append((*key, now.pop(key), -1))
        changes = spark.createDataFrame(batch, CHANGE).coalesce(1)
        IN.write_attempts(changes, path, number, buckets=8)
        if number == 7:
            IN.write_attempts(changes, path, number, buckets=8)  # a batch that runs again
        best, moved = IN.changed_best(best, changes, path, buckets=8)
        best, ranking = stored(best, "best"), stored(IN.changed_ranking(ranking, moved, quizzes), "ranking")
        attempts = spark.createDataFrame([(*k, v) for k, v in now.items()], "id_uz long, id_quizu long, data_wyslania long, zdobyte_pkt double")
        assert rows(ranking, "id_uz", "id_grupy", "pkt") == rows(ranking_from_attempts(attempts, quizzes))
        assert rows(IN.read_attempts(spark, path)) == rows(attempts)


def test_only_the_buckets_concerned_are_read(spark, tmp_path):
    path = str(tmp_path)
    attempts = [(u, q, 1, float(u % 5 + q), 1) for u in range(200) for q in range(3)]
    changes = spark.createDataFrame(attempts, CHANGE)
    IN.write_attempts(changes, path, 0, buckets=16)
    best = stored(IN.changed_best(spark.createDataFrame([], "id_uz long, id_quizu long, best double"), changes, path, 16)[0], "best")
    lost = spark.createDataFrame([(7, 2, 1, 4.0, -1)], CHANGE)
    IN.write_attempts(lost, path, 1, buckets=16)
    after, moved = IN.changed_best(best, lost, path, 16)
    assert rows(moved) == [(7, 2, 4.0, None)] and after.count() == best.count() - 1
    mine = spark.range(7, 8).select(IN.user_bucket(16, "id")).first()[0]
    opened = IN.read_attempts(spark, path, [mine])
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "kubelek" in plan.split("PartitionFilters: [")[1].split("]")[0]
    users = {r[0] for r in opened.select("id_uz").distinct().collect()}
    assert 7 in users and len(users) < 40


def test_counts(spark):
    rng = random.Random(5)
    users = spark.createDataFrame([(u, rng.choice(["user", "teacher", "moderator"])) for u in range(30)], "id_uz long, ranga string")
    groups = spark.createDataFrame([(g,) for g in range(6)], "id_grupy long")
    access = {(g, u) for g in range(6) for u in range(30) if rng.random() < 0.4}
    quizzes = {q: (rng.randrange(6), rng.random() < 0.4) for q in range(40)}

    def members():
        return spark.createDataFrame(sorted(access), "id_grupy long, id_uz long")

    def quiz(items):
        return spark.createDataFrame([(q, g, h) for q, (g, h) in items], "id_quizu long, id_grupy long, ukryty boolean")

    counts = stored(member_counts(groups, members(), users), "counts")
    active = stored(active_quiz_counts(groups, quiz(quizzes.items())), "counts")
    for _ in range(20):
        gone = set(rng.sample(sorted(access), 5))
        came = {(rng.randrange(6), rng.randrange(30)) for _ in range(6)} - access
        access = (access - gone) | came
        changes = spark.createDataFrame([(*k, -1) for k in gone] + [(*k, 1) for k in came], "id_grupy long, id_uz long, zmiana int")
        counts = stored(IN.changed_member_counts(counts, changes, users), "counts")
        before = {q: quizzes.pop(q) for q in rng.sample(sorted(quizzes), 4)}
        after = {q: (rng.randrange(6), rng.random() < 0.4) for q in [*before][:3]} | {1000 + len(before) + rng.randrange(10**6): (rng.randrange(6), False)}
        quizzes |= after
        active = stored(IN.changed_quiz_counts(active, quiz(before.items()), quiz(after.items())), "counts")
    assert rows(counts) == rows(member_counts(groups, members(), users))
    assert rows(active) == rows(active_quiz_counts(groups, quiz(quizzes.items())))


def test_orphans(spark):
    rng, by = random.Random(6), "tabela string, klucz string, wartosc long"
    parents, children = set(range(20)), [(rng.choice("tu"), "k", rng.randrange(30)) for _ in range(60)]

    def keys(values):
        return spark.createDataFrame([(v,) for v in sorted(values)], "wartosc long")

    def anew():
        own = spark.createDataFrame(children, by).join(keys(parents), "wartosc", "left_anti")
        return own.groupBy("tabela", "klucz", "wartosc").count().withColumnRenamed("count", "wiersze")

    held = stored(anew(), "orphans")
    for _ in range(20):
        lost, found = set(rng.sample(sorted(parents), 3)), set(rng.sample(sorted(set(range(30)) - parents), 3))
        parents = (parents - lost) | found
        moves = []
        for _ in range(8):
            if rng.random() < 0.5:
                moves.append((*children.pop(rng.randrange(len(children))), -1))
            else:
                children.append((rng.choice("tu"), "k", rng.randrange(30)))
                moves.append((*children[-1], 1))
        moved = spark.createDataFrame(moves, f"{by}, zmiana int")
        held = stored(IN.changed_orphans(held, moved, keys(lost), keys(found), keys(parents), spark.createDataFrame(children, by)), "orphans")
        assert rows(held) == rows(anew())
