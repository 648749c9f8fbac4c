"""The folder every executor can reach, for tables that must outlive a lost one."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path under the folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, one under the warehouse. Off a local master that has to be on
    a shared file system, so a warehouse without a scheme, or on ``file:``, is an error.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        if not local and ("://" not in warehouse or warehouse.startswith("file:")):
            raise ValueError(f"name a folder that all executors share in {SETTING}; {warehouse} is local to each machine")
        root = f"{warehouse.rstrip('/')}/scratch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def sized(df: DataFrame) -> DataFrame:
    """The rows of a file, with a size estimate nearer to what they take in memory.

    Spark estimates a scan by its compressed bytes and broadcasts what looks small, through the driver: 1.2 million
    quizzes that take 77 MB passed for 2 MB. The size of a join grows with both sides, so the rows meet two
    numbers (16 bytes), which are not kept; a hash is never null, so each row meets one. (An outer join would be
    optimized away below some groupings.) What AQE measures to be small it still broadcasts.
    """
    halves = df.sparkSession.range(2).withColumnRenamed("id", "_half")
    return df.join(F.broadcast(halves), F.pmod(F.hash(df.columns[0]), F.lit(2)) == F.col("_half")).drop("_half")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written under ``shared_folder`` and read back: it is worked out once, here."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
