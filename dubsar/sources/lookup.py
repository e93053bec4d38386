"""A table for point lookups: buckets of a hashed key as folders, sorted by key inside, with Bloom filters.

A lookup names its folder, so the plan reads one bucket's file, and in it the row groups
whose ranges and filters admit the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bucket, and bytes of a row group.
ROWS, GROUP = 50_000, 8 << 20


class Lookup:
    """The table of a folder that write() made: all its rows, or those of one key."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        whole = spark.read.parquet(path)
        self.key, self._whole = key, whole
        self._buckets = whole.agg(F.max("_buckets")).first()[0] or 1
        self.rows = whole.drop("_buckets", "_bucket")

    def at(self, value: str) -> DataFrame:
        return self._whole.where((F.col("_buckets") == self._buckets) & (F.col("_bucket") == _bucket(F.lit(value), self._buckets)) & (F.col(self.key) == value)).drop("_buckets", "_bucket")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write(df: DataFrame, path: str, key: str, rows: int = ROWS) -> Lookup:
    """df, which is read twice, as a lookup table by key."""
    n = df.count()
    buckets = max(1, -(-n // rows))
    if not n:  # a table without rows would get no folder, and so no schema
        df.write.mode("overwrite").parquet(f"{path}/_buckets=1/_bucket=0")
        return Lookup(df.sparkSession, path, key)
    placed = df.withColumns({"_buckets": F.lit(buckets), "_bucket": _bucket(F.col(key), buckets)})
    out = placed.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", key).write.partitionBy("_buckets", "_bucket").mode("overwrite")
    options = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(2 * rows), "parquet.block.size": str(GROUP)}
    out.options(**options).parquet(path)
    return Lookup(df.sparkSession, path, key)
