"""Reading and writing the domain tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.schema import TABLES, schema_of


def load_table(spark: SparkSession, path: str, table: str, time_type=None) -> DataFrame:
    """One table from Parquet under ``path``, with its declared schema."""
    return spark.read.schema(schema_of(table, time_type)).parquet(f"{path}/{table}")


def load_tables(spark: SparkSession, path: str, names=None, time_type=None) -> dict[str, DataFrame]:
    return {name: load_table(spark, path, name, time_type) for name in names or TABLES}


def read_submissions(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None):
    """Submitted forms, as a batch or as a stream of arriving files."""
    reader = (spark.readStream if stream else spark.read).schema(schema_of("submissions"))
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    bounds: tuple[int, int],
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table of a relational database, read in ``partitions`` ranges of ``key``."""
    lower, upper = bounds
    return spark.read.jdbc(
        url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties
    )


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Writes tables as Parquet; user answers go into one folder per day.

    Rebalancing gathers a quiet day into few files and splits a busy one over tasks.
    """
    for name, df in tables.items():
        if name == "odpowiedz_uzytkownika":
            daily = df.withColumn("dzien", F.to_date("data_wyslania")).hint("rebalance", "dzien")
            daily.write.mode(mode).partitionBy("dzien").parquet(f"{path}/{name}")
        else:
            df.write.mode(mode).parquet(f"{path}/{name}")
