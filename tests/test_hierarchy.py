"""The category closure: long chains, forests and cycles against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from gradewell.operators.hierarchy import category_closure, category_cycles
from tests.conftest import rows

EDGES = "id_nadkategorii long, id_podkategorii long"


def walked(edges):
    """Smallest depths by walking from every node."""
    below = {}
    for parent, child in edges:
        if parent is not None and child is not None:
            below.setdefault(parent, set()).add(child)
    out = []
    for start in below:
        seen, level, depth = {}, {start}, 0
        while level:
            depth += 1
            level = {c for n in level for c in below.get(n, ())} - seen.keys()
            seen |= dict.fromkeys(level, depth)
        out += [(start, node, depth) for node, depth in seen.items()]
    return sorted(out, key=repr)


def test_a_chain_of_five_thousand(spark):
    n = 5000
    chain = spark.range(n).select(F.col("id").alias("id_nadkategorii"), (F.col("id") + 1).alias("id_podkategorii"))
    closure = category_closure(chain)
    facts = closure.agg(F.count("*"), F.max("glebokosc"), F.count_if(F.col("id_potomka") - F.col("id_przodka") != F.col("glebokosc"))).first()
    assert tuple(facts) == (n * (n + 1) // 2, n, 0)
    assert category_cycles(closure).isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_cycles(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60) if rng.random() < 0.9 else None, child) for child in range(60)]
    edges += [(70, 70), (80, 81), (81, 82), (82, 80), (82, 83), (1, None)]
    closure = category_closure(spark.createDataFrame(edges, EDGES))
    want = walked(edges)
    assert rows(closure) == want
    pairs = {(a, b): d for a, b, d in want}
    members = sorted((min(b for x, b in pairs if x == a and (b, a) in pairs), a, pairs[a, a]) for a, b in pairs if a == b)
    assert sorted(rows(category_cycles(closure))) == members
    assert {(80, 80, 3), (80, 81, 3), (80, 82, 3), (70, 70, 1)} <= set(members)


def test_several_parents_and_empty_tables(spark):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (1, 4), (1, 2)]
    assert rows(category_closure(spark.createDataFrame(edges, EDGES))) == walked(edges)
    assert category_closure(spark.createDataFrame([], EDGES)).isEmpty()
