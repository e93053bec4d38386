"""Timelines kept up to date by signed deltas of contributions.

State is a folder: facts, a log of contributions with a sign, in buckets of hashed keys; and
cells, the sums, counts and maxima of every key and period, whole for each version. Tablets
that changed take back what they gave and give anew. Sums and counts merge; a maximum is
worked out again only where the largest contribution went, from the buckets of such keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dubsar.functions.columns import chain
from dubsar.operators import analytics

CELL = ["lens", "key", "granularity", "period"]
FACT = ["lens", "key", "tablet", "count", "animal", "tx", "period_y", "period_m", "pos", "seq"]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("lens", "key"), F.lit(buckets)).cast("int")


def _log(signed: DataFrame, path: str, version: int, buckets: int) -> None:
    placed = signed.withColumns({"_buckets": F.lit(buckets), "_bucket": _bucket(buckets)})
    placed.repartition(buckets, "_bucket").write.mode("overwrite").partitionBy("_buckets", "_bucket").parquet(f"{path}/facts/v={version}")


def _by_cell(facts: DataFrame, *sums: Column) -> DataFrame:
    """CELL and sums over facts: by year, by month, and in all."""
    grouped = facts.groupingSets([["lens", "key", "period_y"], ["lens", "key", "period_m"], ["lens", "key"]], "lens", "key", "period_y", "period_m").agg(*sums, F.grouping_id().alias("g"))
    kind = chain([(F.col("g") == 1, F.lit("year")), (F.col("g") == 2, F.lit("month"))], F.lit("total"))
    period = F.when(F.col("g") == 1, F.col("period_y")).when(F.col("g") == 2, F.col("period_m")).otherwise("")
    return grouped.where("NOT (g = 2 AND period_m IS NULL)").select("lens", "key", kind.alias("granularity"), period.alias("period"), *(c for c in grouped.columns if c not in ("lens", "key", "period_y", "period_m", "g")))


def create(contrib: DataFrame, path: str, buckets: int = 64) -> None:
    """Version 0 of the state, from all contributions; a third of all rows may lie in one key, and so in one bucket's files."""
    _log(contrib.select(*FACT, F.lit(1).alias("sign")), path, 0, buckets)
    cells = _by_cell(contrib, F.sum("count").alias("total_count"), F.count(F.lit(1)).alias("tablets"), F.max("count").alias("max_count"))
    cells.write.mode("overwrite").parquet(f"{path}/cells/v=0")


def latest(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/cells").agg(F.max("v")).first()[0]


def update(spark: SparkSession, path: str, old: DataFrame, new: DataFrame) -> int:
    """The next version, after old contributions of some tablets gave way to new ones; its number."""
    version = latest(spark, path)
    facts = spark.read.parquet(f"{path}/facts")
    buckets = facts.agg(F.max("_buckets")).first()[0] or 64
    _log(old.select(*FACT, F.lit(-1).alias("sign")).unionByName(new.select(*FACT, F.lit(1).alias("sign"))), path, version + 1, buckets)
    delta = spark.read.schema(facts.schema).parquet(f"{path}/facts/v={version + 1}")
    signed = lambda sign: F.max(F.when(F.col("sign") == sign, F.col("count")))
    changes = _by_cell(delta, F.sum(F.col("count") * F.col("sign")).alias("d_count"), F.sum("sign").alias("d_tablets"), signed(1).alias("came"), signed(-1).alias("went"))
    cells = spark.read.parquet(f"{path}/cells/v={version}")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    merged = cells.join(changes, CELL, "full").withColumns({"total_count": zero("total_count") + zero("d_count"), "tablets": zero("tablets") + zero("d_tablets")}).where("tablets > 0")
    # The largest is lost where as large a one went and none as large came.
    lost = F.coalesce((F.col("went") >= F.col("max_count")) & (F.col("max_count") > F.coalesce("came", F.lit(-(1 << 62)))), F.lit(False))
    merged = merged.withColumn("lost", lost).withColumn("max_count", F.greatest("max_count", "came"))

    again = merged.where("lost").select("lens", "key").distinct().withColumn("_bucket", _bucket(buckets))
    asked = [r[0] for r in again.select("_bucket").distinct().collect()]  # buckets at most
    log = spark.read.schema(facts.schema).parquet(f"{path}/facts").where((F.col("_buckets") == buckets) & F.col("_bucket").isin(asked)).where(F.col("v") <= version + 1)
    left = log.join(again.select("lens", "key"), ["lens", "key"], "left_semi").groupBy(*FACT).agg(F.sum("sign").alias("copies")).where("copies > 0")
    maxima = _by_cell(left, F.max("count").alias("new_max"))
    done = merged.join(maxima, CELL, "left").select(*CELL, "total_count", "tablets", F.when(F.col("lost"), F.col("new_max")).otherwise(F.col("max_count")).alias("max_count"))
    done.write.mode("overwrite").parquet(f"{path}/cells/v={version + 1}")
    return version + 1


def timeline(spark: SparkSession, path: str, lens: str = "animal", min_tablets: int | None = None) -> DataFrame:
    """analytics.timeline, unfiltered, from the cells of the latest version."""
    least = (2 if lens == "animal" else 1) if min_tablets is None else min_tablets
    cells = spark.read.parquet(f"{path}/cells/v={latest(spark, path)}").where(F.col("lens") == lens)
    kept = cells.where("granularity = 'total'").where(F.col("tablets") >= least).select("key")
    return cells.join(kept, "key", "left_semi").select("key", "granularity", "period", "total_count", "tablets", "max_count", analytics.category_of(lens)(F.col("key")).alias("category"))
