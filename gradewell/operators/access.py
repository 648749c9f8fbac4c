"""Access rules: ranks, ownership and the bits of a membership row.

Requests come as rows, so every rule is a set of key joins over all requests.
No join is hinted: Spark broadcasts a side only when its measured size is small,
and AQE splits a popular group or user otherwise.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.scalar import has_bits, privilege_mask
from gradewell.schema import LIMBO_USER, PRIVILEGES, SUPERUSER_RANKS


def is_superuser(rank="ranga") -> Column:
    return F.coalesce(F.col(rank).isin(*SUPERUSER_RANKS), F.lit(False))


def user_roles(users: DataFrame) -> DataFrame:
    rank = F.col("ranga")
    superuser = is_superuser()
    return users.select(
        "id_uz",
        (rank == "user").alias("zwykly"),
        (rank == "teacher").alias("nauczyciel"),
        (rank == "moderator").alias("moderator"),
        (rank == "administrator").alias("administrator"),
        superuser.alias("superuser"),
        (superuser | (rank == "teacher")).alias("moze_tworzyc_grupy"),
    )


def with_standing(
    requests: DataFrame,
    users: DataFrame,
    groups: DataFrame,
    access: DataFrame,
    user: str = "id_uz",
    group: str = "id_grupy",
    user_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Adds what the rules look at: ``_ranga``, ``_wlasciciel`` and ``_prawa`` (null when absent).

    ``user_columns`` are taken along from the users, which saves joining them again.
    """
    ranks = users.select(F.col("id_uz").alias(user), F.col("ranga").alias("_ranga"), *user_columns)
    owners = groups.select(F.col("id_grupy").alias(group), F.col("id_wlasciciela").alias("_wlasciciel"))
    rights = access.select(
        F.col("id_uz").alias(user), F.col("id_grupy").alias(group), F.col("prawa_dost").alias("_prawa")
    )
    return requests.join(ranks, user, "left").join(owners, group, "left").join(rights, [user, group], "left")


def granted(mask, user: str = "id_uz") -> Column:
    """Superuser, or owner of the group, or all bits of ``mask`` in the membership row."""
    owner = F.coalesce(F.col("_wlasciciel") == F.col(user), F.lit(False))
    return is_superuser("_ranga") | owner | has_bits("_prawa", mask)


def has_privileges(
    requests: DataFrame,
    *names: str,
    users: DataFrame,
    groups: DataFrame,
    access: DataFrame,
    user: str = "id_uz",
    group: str = "id_grupy",
    name: str = "dozwolone",
) -> DataFrame:
    """Adds a flag: may ``user`` do all of ``names`` in ``group``."""
    standing = with_standing(requests, users, groups, access, user, group)
    return standing.select(*requests.columns, granted(privilege_mask(*names), user).alias(name))


def privilege_matrix(access: DataFrame) -> DataFrame:
    """One flag per privilege for every membership row."""
    return access.select(
        "id_grupy", "id_uz", *[has_bits("prawa_dost", mask).alias(name) for name, mask in PRIVILEGES.items()]
    )


# What each quiz action asks for.
ACTION_PRIVILEGE = {
    "play": "participation_in_quizzes",
    "edit": "editing_and_deleting_quizzes",
    "delete": "editing_and_deleting_quizzes",
    "create": "creation_of_quizzes",
}
UNENFORCED_ACTIONS = ["create"]


def quiz_privilege_check(
    requests: DataFrame, users: DataFrame, groups: DataFrame, access: DataFrame
) -> DataFrame:
    """May the user do ``akcja`` in the group.

    ``zablokowane`` tells whether the request is stopped: the create rule is
    evaluated but never stops anyone.
    """
    masks = F.create_map(
        *[F.lit(x) for action, name in ACTION_PRIVILEGE.items() for x in (action, privilege_mask(name))]
    )
    allowed = granted(F.coalesce(masks[F.col("akcja")], F.lit(privilege_mask("?"))))
    return with_standing(requests, users, groups, access).select(
        *requests.columns,
        allowed.alias("dozwolone"),
        (~allowed & ~F.col("akcja").isin(*UNENFORCED_ACTIONS)).alias("zablokowane"),
    )


def removal_check(requests: DataFrame, users: DataFrame, groups: DataFrame, access: DataFrame) -> DataFrame:
    """Verdict for (id_aktora, id_uz, id_grupy): may the actor remove the user from the group.

    The first rule that fails gives the verdict.
    """
    known_user = users.select("id_uz", F.lit(True).alias("_jest_uz"))
    enrolled = access.select("id_uz", "id_grupy", F.lit(True).alias("_zapisany"))
    standing = (
        with_standing(requests, users, groups, access, user="id_aktora")
        .join(known_user, "id_uz", "left")
        .join(enrolled, ["id_uz", "id_grupy"], "left")
    )
    verdict = F.coalesce(
        F.when(F.col("_wlasciciel").isNull(), "no_group"),
        F.when(F.col("_jest_uz").isNull(), "no_user"),
        F.when(F.col("_zapisany").isNull(), "not_enrolled"),
        F.when(F.col("_wlasciciel") == F.col("id_uz"), "is_owner"),
        F.when(
            ~(granted(privilege_mask("deleting_users"), "id_aktora") | (F.col("id_aktora") == F.col("id_uz"))),
            "no_privilege",
        ),
        F.lit("ok"),
    )
    return standing.select(*requests.columns, verdict.alias("werdykt"))


def profile_edit_check(requests: DataFrame, users: DataFrame) -> DataFrame:
    """May ``id_aktora`` edit the profile of ``id_uz``: oneself, or a superuser."""
    ranks = users.select(F.col("id_uz").alias("id_aktora"), F.col("ranga").alias("_ranga"))
    known = users.select("id_uz", F.lit(True).alias("_jest_uz"))
    verdict = (
        F.when(F.col("_jest_uz").isNull(), "no_user")
        .when((F.col("id_aktora") == F.col("id_uz")) | is_superuser("_ranga"), "ok")
        .otherwise("no_privilege")
    )
    return (
        requests.join(ranks, "id_aktora", "left")
        .join(known, "id_uz", "left")
        .select(*requests.columns, verdict.alias("werdykt"))
    )


def limbo_access(users: DataFrame) -> DataFrame:
    """Only superusers may open the holding area."""
    return users.select("id_uz", is_superuser().alias("dozwolone"))


def not_limbo_user(column: str = "id_uz") -> Column:
    return F.col(column) != LIMBO_USER
