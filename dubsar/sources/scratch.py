"""Intermediate tables in the folder that every executor reaches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, in local mode alone."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder: on a cluster tables must lie where all executors see them")
        folder = "file://" + tempfile.mkdtemp(prefix="dubsar-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path there."""
    return f"{shared_folder(spark)}/dubsar-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: lineage ends there, and lost executors lose nothing."""
    df.write.option("compression", "zstd").parquet(path := scratch_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a file and tasks a core while tables are worked out whose rows are much work.
ROWS_A_FILE, TASKS_A_CORE = 50_000, 4


@contextmanager
def dealt_finely(spark: SparkSession) -> Iterator[None]:
    """Tables written and read meanwhile are dealt to several tasks a core: Spark deals files by bytes, and texts are few bytes and much work."""
    want = {"spark.sql.files.maxRecordsPerFile": ROWS_A_FILE, "spark.sql.files.minPartitionNum": TASKS_A_CORE * spark.sparkContext.defaultParallelism}
    had = {k: spark.conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_table(rows: DataFrame, *keys: str) -> Callable[..., Column]:
    """rows, of bounded number and size and with distinct keys, as one value that goes to all tasks; gives a function from keys to the row, null where there is none.

    The value is an array of buckets by hash, so that a row is found without a join wherever an expression can stand, inside arrays too.
    """
    spark = rows.sparkSession
    size = 1 << max(rows.count(), 1).bit_length()
    at = lambda *c: F.pmod(F.xxhash64(*c), F.lit(size))
    held = rows.groupBy(at(*keys).alias("at")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    buckets = spark.range(size).join(held, F.col("id") == F.col("at"), "left").select("id", F.coalesce("rows", F.array().cast(held.schema["rows"].dataType)).alias("rows"))
    one = buckets.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "rows"))), lambda b: b["rows"]).alias("table"))
    # Inside arrays a literal can stand where a subquery cannot; the optimizer reads this one once.
    table = F.from_json(F.lit(one.select(F.to_json(F.struct("table"))).first()[0]), one.schema)["table"]

    def find(*c: Column) -> Column:
        same = lambda r: reduce(Column.__and__, (r[k].eqNullSafe(v) for k, v in zip(keys, c, strict=True)))
        return F.get(F.filter(F.get(table, at(*c).cast("int")), same), F.lit(0))

    return find
