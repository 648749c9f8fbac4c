import pytest

from gradewell.functions.scalar import privilege_mask
from gradewell.operators import access, catalog, changes, relations
from tests.conftest import rows


@pytest.fixture(scope="module")
def world(spark):
    users = spark.createDataFrame(
        [(0, "limbo", "user"), (1, "boss", "moderator"), (2, "owner", "user"), (3, "member", "user"),
         (4, "editor", "user"), (5, "stranger", "user"), (6, "admin", "administrator"), (7, "nauczyciel", "teacher")],
        "id_uz long, nazwa_uz string, ranga string",
    )
    groups = spark.createDataFrame(
        [(0, 0, "LIMBO", False, None), (1, 1, "public", False, None), (2, 2, "zamknieta", True, "x"),
         (3, 2, "otwarta", False, "  ")],
        "id_grupy long, id_wlasciciela long, nazwa string, na_zaproszenie boolean, haslo string",
    )
    members = spark.createDataFrame(
        [(2, 3, "1100000000000000"), (2, 4, "1111100000000001"), (1, 3, "0000000000000000"), (2, 2, "0000000000000000")],
        "id_grupy long, id_uz long, prawa_dost string",
    )
    return {"users": users, "groups": groups, "access": members}


def allowed(spark, world, pairs, *names):
    df = spark.createDataFrame(pairs, "id_uz long, id_grupy long")
    got = access.has_privileges(df, *names, **world)
    return {(r.id_uz, r.id_grupy): r.dozwolone for r in got.collect()}


def test_masks():
    assert privilege_mask("participation_in_quizzes", "creation_of_quizzes") == (1 << 15) | (1 << 13)
    assert privilege_mask("access_to_group") == 0
    assert privilege_mask("deleting_users") == 1


def test_superuser_owner_bits_and_missing_row(spark, world):
    pairs = [(1, 2), (6, 2), (2, 2), (3, 2), (4, 2), (5, 2), (3, 1), (9, 2), (3, 9)]
    assert allowed(spark, world, pairs, "editing_and_deleting_quizzes") == {
        (1, 2): True, (6, 2): True, (2, 2): True, (3, 2): False, (4, 2): True, (5, 2): False, (3, 1): False,
        (9, 2): False, (3, 9): False,
    }


def test_all_named_bits_are_needed(spark, world):
    pairs = [(3, 2), (4, 2)]
    assert allowed(spark, world, pairs, "participation_in_quizzes", "creation_of_quizzes") == {
        (3, 2): False, (4, 2): True,
    }


def test_unknown_name_asks_for_lowest_bit(spark, world):
    assert allowed(spark, world, [(3, 2), (4, 2)], "deleting_users") == {(3, 2): False, (4, 2): True}


def test_empty_mask_passes_any_member(spark, world):
    assert allowed(spark, world, [(3, 1), (5, 1)], "access_to_group") == {(3, 1): True, (5, 1): False}


def test_removal_verdicts(spark, world):
    df = spark.createDataFrame(
        [(1, 3, 9), (1, 99, 2), (1, 5, 2), (1, 2, 2), (3, 4, 2), (3, 3, 2), (4, 3, 2), (1, 3, 2)],
        "id_aktora long, id_uz long, id_grupy long",
    )
    got = {(r.id_aktora, r.id_uz, r.id_grupy): r.werdykt for r in access.removal_check(df, **world).collect()}
    assert got == {
        (1, 3, 9): "no_group", (1, 99, 2): "no_user", (1, 5, 2): "not_enrolled", (1, 2, 2): "is_owner",
        (3, 4, 2): "no_privilege", (3, 3, 2): "ok", (4, 3, 2): "ok", (1, 3, 2): "ok",
    }


def test_create_check_never_blocks(spark, world):
    df = spark.createDataFrame(
        [(5, 2, 1, "create"), (5, 2, 1, "edit"), (3, 2, 1, "play")],
        "id_uz long, id_grupy long, id_quizu long, akcja string",
    )
    got = {r.akcja: (r.dozwolone, r.zablokowane) for r in access.quiz_privilege_check(df, **world).collect()}
    assert got == {"create": (False, False), "edit": (False, True), "play": (True, False)}


@pytest.mark.parametrize("mode", ["as_coded", "documented"])
def test_visible_groups_match_whole_lists(spark, world, mode):
    """Every pair is asked for, so the answer must be the full list of every viewer."""
    users = [r.asDict() for r in world["users"].collect()]
    groups = sorted((r.asDict() for r in world["groups"].collect()), key=lambda g: g["id_grupy"])
    enrolled = {(r.id_uz, r.id_grupy) for r in world["access"].collect()}
    want = []
    for u in users:
        place = 0
        for g in groups:
            inside = (u["id_uz"], g["id_grupy"]) in enrolled
            hidden = g["na_zaproszenie"] and (inside if mode == "as_coded" else not inside)
            if g["id_grupy"] == 0 or (hidden and u["ranga"] not in ("moderator", "administrator")):
                continue
            place += 1
            want.append((u["id_uz"], g["id_grupy"], place))
    asked = world["users"].select("id_uz").join(world["groups"].select("id_grupy"))
    got = catalog.visible_groups(asked, **world, mode=mode)
    assert rows(got, "id_uz", "id_grupy", "place") == sorted(want, key=repr)


def test_group_card_blank_password(world):
    got = {r.id_grupy: (r.na_zaproszenie, r.chroniona_haslem) for r in catalog.group_card(world["groups"]).collect()}
    assert got == {0: ("NIE", "NIE"), 1: ("NIE", "NIE"), 2: ("TAK", "TAK"), 3: ("NIE", "NIE")}


def test_enrol_then_remove_restores(spark, world):
    visits = spark.createDataFrame([(5, 3), (5, 3), (5, 2), (5, 77), (3, 2)], "id_uz long, id_grupy long")
    state, rejected = changes.enroll_visits(visits, world["groups"], world["access"])
    assert rows(rejected, "id_uz", "id_grupy", "powod") == [(5, 2, "invite_only"), (5, 77, "no_group")]
    assert (3, 5, "1100000000000000") in rows(state)
    requests = spark.createDataFrame([(5, 5, 3)], "id_aktora long, id_uz long, id_grupy long")
    back, refused = changes.remove_members(requests, world["users"], world["groups"], state)
    assert rows(back) == rows(world["access"])
    assert refused.count() == 0


def test_enrolled_and_not(spark, world):
    asked = spark.createDataFrame([(3, 2), (5, 2)], "id_uz long, id_grupy long")
    assert rows(relations.enrolled(asked, world["access"])) == [(3, 2)]
    assert rows(relations.not_enrolled(asked, world["access"])) == [(5, 2)]
