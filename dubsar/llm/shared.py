"""What the operators share: tables in the cluster's shared folder, columns bound once, bounded Arrow batches."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a temporary one, in local mode (tests) alone."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder: on a cluster tables must lie where all executors see them")
        at = "file://" + tempfile.mkdtemp(prefix="dubsar-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the session's Python ends."""
    path = f"{shared_dir(spark)}/dubsar-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that fresh_path named; a session that has ended already leaves it."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  the gateway may be gone
        return


#: Rows of a few numbers that go to one file where the number of rows is known.
ROWS_A_FILE = 50_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    rows, where known: how many rows of a few numbers there are at most. They go to as few tasks and files as hold them, however many partitions df has.
    """
    spark = df.sparkSession
    (df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)).write.parquet(path := fresh_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes: texts may be long."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}", str(most)).removesuffix("b"))
        if now > most or now <= 0:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


_MADE: dict = {}


def per_process(make: Callable, path: str):
    """make(path), kept for the life of the Python worker as long as the file stays the same: many small tasks share one."""
    found = os.stat(path)
    key = (make.__module__, make.__qualname__, path, found.st_size, found.st_mtime_ns)
    if key not in _MADE:
        _MADE[key] = make(path)
    return _MADE[key]


def other_columns(columns: list[str], text: str, new: Iterable[str]) -> list[str]:
    """Columns that stay beside new ones: neither text nor, in whatever case, of a new one's name."""
    shadowed = {n.lower() for n in new}
    return [c for c in columns if c != text and c.lower() not in shadowed]


def free_name(columns: list[str], name: str) -> str:
    """name, or name with as many underscores after it as make it new among columns."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def with_key(docs: DataFrame, name: str = "near-keyed") -> tuple[DataFrame, str]:
    """docs with a column, named second, that tells rows apart in the order of doc_id: doc_id itself, or where ids are null or repeat, the place by id, nulls last."""
    key = free_name(docs.columns, "_key")
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if n["rows"] == n["ids"]:
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    return stored(docs.orderBy(F.col("doc_id").asc_nulls_last()).withColumn(key, F.monotonically_increasing_id()), name), key


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows with _rank, the place from 0 by order (nulls first) among those of equal group, and the groups with _size.

    Rows are sorted by range over all partitions and stored with their place there, so a group of any size is
    spread over partitions; what is gathered by group is one row for each partition that holds some of it. rows
    is read twice (once to find the ranges), so store it first where it is dear. group holds no nulls.
    """
    part, place, rank, size = (free_name(rows.columns, n) for n in ("_part", "_place", "_rank", "_size"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    placed = stored(spread.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), f"{name}-placed")
    pieces = placed.groupBy(group, part).agg(F.min(place).alias("_from"), F.count(F.lit(1)).alias("_rows"))
    along = Window.partitionBy(group).orderBy(part)
    before = F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = stored(pieces.select(group, part, (before - F.col("_from")).alias("_shift"), F.sum("_rows").over(Window.partitionBy(group)).alias(size)), f"{name}-pieces")
    found = placed.join(pieces, [group, part]).withColumn(rank, F.col(place) + F.col("_shift")).select(*rows.columns, rank, size)
    return found, pieces.groupBy(group).agg(F.first(size).alias(size))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
