"""Deletes that follow the foreign keys.

Every foreign key has a policy for rows whose parent goes: the row goes too, or takes other
values. From rows of any tables that are to go, the keys that go with them are worked out table by
table, parents first, until nothing is added; then each table that is reached gets its new state.
"""

from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.operators.relations import FOREIGN_KEYS
from gradewell.operators.skew import own_shuffle
from gradewell.schema import LIMBO_GROUP, LIMBO_USER

DELETE = "delete"

#: What happens to a row whose parent goes, by (table, key): ``DELETE``, or the values it gets. Keys
#: that are not named here delete. A quiz without owner goes to the holding area.
POLICIES: dict[tuple[str, str], str | dict[str, int]] = {
    ("grupa_quizowa", "id_wlasciciela"): {"id_wlasciciela": LIMBO_USER},
    ("pytanie", "id_autora"): {"id_autora": LIMBO_USER},
    ("quiz", "id_wlasciciela"): {"id_wlasciciela": LIMBO_USER, "id_grupy": LIMBO_GROUP},
    ("quiz", "id_grupy"): {"id_grupy": LIMBO_GROUP},
}

#: Rows that take what others leave, and so stay themselves.
KEPT = {"uzytkownik": LIMBO_USER, "grupa_quizowa": LIMBO_GROUP}

PRIMARY_KEYS = {parent: key for _, _, parent, key in FOREIGN_KEYS}


def doomed_keys(start: dict[str, DataFrame], tables: dict[str, DataFrame], policies: dict | None = None) -> dict[str, DataFrame]:
    """The primary keys that go, by table, when those of ``start`` go. A key that is named twice, or
    is in no table, does no harm."""
    policies = POLICIES if policies is None else policies
    deleting = [(c, k, p) for c, k, p, _ in FOREIGN_KEYS if policies.get((c, k), DELETE) == DELETE and c in PRIMARY_KEYS]
    order = TopologicalSorter({table: {p for c, _, p in deleting if c == table} for table in PRIMARY_KEYS}).static_order()
    doomed: dict[str, DataFrame] = {}
    for table in order:
        own = PRIMARY_KEYS[table]
        found = [start[table].select(own)] if table in start else []
        for child, key, parent in deleting:
            if child == table and parent in doomed:
                gone = doomed[parent].select(F.col(PRIMARY_KEYS[parent]).alias(key))
                found.append(tables[table].join(gone, key, "left_semi").select(own))
        if found:
            keys = reduce(DataFrame.unionByName, found).filter(F.col(own).isNotNull()).distinct()
            doomed[table] = keys.filter(F.col(own) != KEPT[table]) if table in KEPT else keys
    return doomed


def cascade(start: dict[str, DataFrame], tables: dict[str, DataFrame], policies: dict | None = None) -> dict[str, DataFrame]:
    """The new state of every table that the deletion of ``start`` (table: its keys) reaches.

    ``tables`` holds the tables that are reached; one that is not there is a ``KeyError``.
    Each is read once and meets the doomed keys of its parents; big tables are
    never grouped, so popular keys can be split.
    """
    policies = POLICIES if policies is None else policies
    doomed = doomed_keys(start, tables, policies)
    out: dict[str, DataFrame] = {}
    for child in dict.fromkeys([*PRIMARY_KEYS, *(c for c, *_ in FOREIGN_KEYS)]):
        keys = [(k, p, policies.get((child, k), DELETE)) for c, k, p, _ in FOREIGN_KEYS if c == child and p in doomed]
        if not keys and child not in doomed:
            continue
        state = columns = tables[child]
        if child in doomed:
            state = state.join(doomed[child], PRIMARY_KEYS[child], "left_anti")
        for key, parent, policy in keys:
            gone = doomed[parent].select(F.col(PRIMARY_KEYS[parent]).alias(key))
            if policy == DELETE:
                # rows that went with the table's own key are out already
                if child not in PRIMARY_KEYS:
                    state = state.join(gone, key, "left_anti")
                continue
            flagged = own_shuffle(gone.withColumn("_gone", F.lit(True)), key)
            moved = F.col("_gone").isNotNull()
            state = state.join(flagged, key, "left").withColumns(
                {c: F.when(moved, F.lit(v)).otherwise(F.col(c)).cast("bigint") for c, v in policy.items()}
            ).drop("_gone")
        out[child] = state.select(*columns.columns)
    return out
