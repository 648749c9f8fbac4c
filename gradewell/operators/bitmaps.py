"""Memberships and rights as bitmaps.

The members of a group that hold a right are bits: one bitmap for each group and 32,768 neighbouring
user ids, built with partial aggregation. A request then meets one bitmap instead of a
membership row, and bitmaps of popular groups are many small rows, never one large one.
A bitmap has 4 KB whatever it holds: it pays where a group has some hundred members among
32,768 neighbouring ids, and costs more than the rows where groups are thinly spread.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.scalar import has_bits, privilege_mask
from gradewell.operators.access import is_superuser
from gradewell.operators.skew import own_shuffle


def right_bitmaps(access: DataFrame, rights: dict[str, Column] | None = None) -> DataFrame:
    """(id_grupy, _kubelek, and a bitmap for each of ``rights``): the users whose membership row
    fulfils each condition; by default the members, as ``czlonkowie``. Rows without user or group
    are no memberships."""
    rights = rights or {"czlonkowie": F.lit(True)}
    rows = access.filter("id_uz IS NOT NULL AND id_grupy IS NOT NULL")
    # where the condition fails the position is null, and null sets no bit
    bits = [F.bitmap_construct_agg(F.when(holds, F.bitmap_bit_position("id_uz"))).alias(name) for name, holds in rights.items()]
    return rows.groupBy("id_grupy", F.bitmap_bucket_number("id_uz").alias("_kubelek")).agg(*bits)


def is_set(bitmap: str, user: str = "id_uz") -> Column:
    """Whether the user's bit is set in a bitmap of the user's bucket; false where there is none."""
    place = F.bitmap_bit_position(user)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def with_bitmaps(requests: DataFrame, bitmaps: DataFrame, user: str = "id_uz", group: str = "id_grupy") -> DataFrame:
    """``requests`` with the bitmaps of their group and user's bucket, null where there are none."""
    own = own_shuffle(bitmaps, "id_grupy").withColumnRenamed("id_grupy", group)
    return requests.withColumn("_kubelek", F.bitmap_bucket_number(user)).join(own, [group, "_kubelek"], "left").drop("_kubelek")


def is_enrolled(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``zapisany``: is the user a member of the group. ``members`` are ``right_bitmaps``."""
    return with_bitmaps(requests, members).select(*requests.columns, is_set("czlonkowie").alias("zapisany"))


def not_enrolled(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Only the requests of non-members."""
    return with_bitmaps(requests, members).filter(~is_set("czlonkowie")).select(*requests.columns)


def has_privileges(
    requests: DataFrame, *names: str, users: DataFrame, groups: DataFrame, access: DataFrame, name: str = "dozwolone"
) -> DataFrame:
    """Adds a flag: superuser, owner of the group, or all rights of ``names`` in the membership."""
    held = right_bitmaps(access, {"_mapa": has_bits("prawa_dost", privilege_mask(*names))})
    ranks = users.select("id_uz", is_superuser().alias("_super"))
    owners = groups.select("id_grupy", F.col("id_wlasciciela").alias("_wlasciciel"))
    met = with_bitmaps(requests.join(ranks, "id_uz", "left").join(owners, "id_grupy", "left"), held)
    allowed = F.coalesce("_super", F.lit(False)) | F.coalesce(F.col("_wlasciciel") == F.col("id_uz"), F.lit(False)) | is_set("_mapa")
    return met.select(*requests.columns, allowed.alias(name))
