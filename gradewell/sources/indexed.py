"""Tables laid out for look-ups by key.

Rows are dealt and sorted by the key, so a row group holds a narrow range of keys, and every row
group has a Bloom filter of its keys. A look-up sends its keys to the scan as a filter: row groups
whose range or filter excludes all of them are not read.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.operators.catalog import lookup_by_key, template_lookup

#: Keys that a look-up sends to the scan at most; with more of them the table is joined as a whole.
MOST_KEYS = 10_000


def write_indexed(df: DataFrame, path: str, key: str, group_bytes: int = 128 << 20, keys_in_group: int = 1_000_000) -> None:
    """Writes ``df`` for look-ups by ``key``. ``keys_in_group`` is how many different keys a row group
    may hold; it sizes the Bloom filters."""
    (
        df.repartitionByRange(key)
        .sortWithinPartitions(key)
        .write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(keys_in_group))
        .option("parquet.block.size", str(group_bytes))
        .parquet(path)
    )


def narrowed(table: DataFrame, keys: DataFrame, key: str, most: int = MOST_KEYS) -> DataFrame:
    """The rows of ``table`` with one of ``keys``, by a filter that the scan can use. More than
    ``most`` keys leave the table as it is; whoever joins it finds the same rows."""
    wanted = [r[0] for r in keys.select(key).filter(F.col(key).isNotNull()).distinct().limit(most + 1).collect()]
    return table if len(wanted) > most else table.filter(F.col(key).isin(wanted))


def lookup_indexed(spark: SparkSession, keys: DataFrame, path: str, key: str, most: int = MOST_KEYS) -> tuple[DataFrame, DataFrame]:
    """``catalog.lookup_by_key`` on a table that ``write_indexed`` wrote."""
    return lookup_by_key(keys, narrowed(spark.read.parquet(path), keys, key, most), key)


def template_lookup_indexed(spark: SparkSession, lookups: DataFrame, path: str, most: int = MOST_KEYS) -> DataFrame:
    """``catalog.template_lookup`` on template answers written for look-ups by ``id_pyt``."""
    return template_lookup(lookups, narrowed(spark.read.parquet(path), lookups, "id_pyt", most))
