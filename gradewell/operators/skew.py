"""Keeping joins open to skew handling at run time.

AQE splits an oversized partition of a sort-merge join only when both sides come
straight out of a shuffle of that join. A side that was grouped or joined by the
same key before brings its layout along, gets no shuffle of its own, and the
other side's popular keys then stay in one task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def own_shuffle(df: DataFrame, key: str) -> DataFrame:
    """The same rows, with ``key`` computed anew so that no earlier layout fits it.

    For the smaller side of a join whose other side may hold popular keys. The
    expression must be one that the optimizer does not see through.
    """
    if dict(df.dtypes)[key] == "string":
        return df.withColumn(key, F.concat(key, F.lit("")))
    return df.withColumn(key, F.shiftleft(key, 0))


def without(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the grouped ``df`` whose keys are not in ``other``.

    Spark moves an anti join below a grouping by the same keys and so shuffles
    every row. An outer join stays above it: rows are combined map-side first.
    """
    there = other.select(*on, F.lit(True).alias("_there"))
    return df.join(there, on, "left").filter(F.col("_there").isNull()).select(*df.columns)
