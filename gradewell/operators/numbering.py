"""Row numbers and running sums without one task per group.

A plain window sends a whole group to one task. Here rows are dealt to parts by range of
(group, order), so a big group lies in several parts, one after the other. Each part is summed up
by itself; only the group that a part begins with can have rows in earlier parts, so there is
one number at most to carry into each part.

The dealt rows are written once to the shared folder. Both steps read them there: the input is
worked out once, and a lost executor that reads again sees the same parts.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.sources.shared import stored

PART = "_part"


def swept(
    df: DataFrame,
    order: list[Column],
    sums: dict[str, Column],
    by: list[str] | None = None,
    ties: list[Column] | None = None,
    keep_part: bool = False,
) -> DataFrame:
    """Adds running sums over each group ``by`` under ``order``, the row itself included.

    Rows that are equal in ``by`` and ``order`` lie in one part, in the order of ``ties``. Rows with
    a null group form a group. Nulls in ``order`` come first, or last where it falls.
    ``keep_part`` leaves the part's number in column ``_part``.
    """
    by, ties = list(by or []), list(ties or [])
    adds = {name: f"_add_{name}" for name in sums}
    dealt = df.withColumns({adds[name]: column for name, column in sums.items()})
    dealt = dealt.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id())
    rows = stored(dealt, "swept")

    totals = rows.groupBy(*by, PART).agg(*[F.sum(add).alias(add) for add in adds.values()])
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col(PART).alias("_into"),
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.lag(PART).over(Window.partitionBy(*by).orderBy(PART)).isNotNull().alias("_goes_on"),
        *[F.coalesce(F.sum(add).over(earlier), F.lit(0)).alias(f"_carried_{name}") for name, add in adds.items()],
    ).filter("_goes_on")  # one row a part at most
    here = F.col(PART) == F.col("_into")
    for b in by:
        here = here & F.col(b).eqNullSafe(F.col(f"_by_{b}"))

    upto = Window.partitionBy(PART, *by).orderBy(*order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"_inside_{name}": F.sum(add).over(upto) for name, add in adds.items()})
    return inside.join(F.broadcast(carried), here, "left").select(
        *df.columns,
        *([PART] if keep_part else []),
        *[(F.col(f"_inside_{name}") + F.coalesce(f"_carried_{name}", F.lit(0))).alias(name) for name in sums],
    )


def least_before(df: DataFrame, order: list[Column], value: str, name: str, by: list[str]) -> DataFrame:
    """Adds the least ``value`` of the earlier rows of each group, null where there is none, to rows
    that ``swept`` has given with the same groups and order and with their part."""
    plain = df.columns
    totals = df.groupBy(*by, PART).agg(F.min(value).alias("_least"))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col(PART).alias("_into"), *[F.col(b).alias(f"_by_{b}") for b in by], F.min("_least").over(earlier).alias("_carried")
    ).filter("_carried IS NOT NULL")  # one row a part at most
    here = F.col(PART) == F.col("_into")
    for b in by:
        here = here & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    inside = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = df.withColumn("_inside", F.min(value).over(inside)).join(F.broadcast(carried), here, "left")
    return found.select(*plain, F.least("_inside", "_carried").alias(name))


def numbered(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "place") -> DataFrame:
    """1-based position of each row in its group ``by`` under ``order``, which should tell rows apart."""
    return swept(df, order, {name: F.lit(1).cast("long")}, by)


def numbered_by_id(df: DataFrame, key: str, by: list[str] | None = None, name: str = "place") -> DataFrame:
    """``numbered`` for lists ordered by an id that is unique inside its group."""
    return numbered(df, [F.col(key)], by, name)
