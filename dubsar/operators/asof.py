"""As-of join: each row meets the phase of its key in which its time lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dubsar.sources.scratch import stored

#: Phases in all, and of one key, up to which the table of phases is broadcast: a row is held against all phases of its key there.
MOST_PHASES, MOST_OF_KEY = 10_000, 64
_FIRST, _OPEN = -(1 << 63), (1 << 63) - 1


def as_of(rows: DataFrame, phases: DataFrame, key: str, at: str, until: str) -> DataFrame:
    """rows with the columns of the phase of equal key that ends first at or after their time; null where the key has no phase.

    phases: key, until (the last time that belongs to it; null: open), and what it tells. Times are long. Later
    than all phases, a row gets the last one; without a time it gets the first. Of phases of one key that end
    together the least by what they tell counts. Rows of null key have no phase.

    A few phases are broadcast. Beyond, rows and phases are sorted together by range over all partitions, rows of
    one key and time spread by a hash; each partition looks to its own next phase, and what it lacks comes from a
    table of one row a key and partition. No key gathers in one task, however many rows or phases it has.
    """
    told = [c for c in phases.columns if c not in (key, until)]
    known = phases.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.coalesce(F.col(until), F.lit(_OPEN)).alias("_o"), F.struct(*told).alias("_v")).groupBy("_k", "_o").agg(F.min("_v").alias("_v"))
    few = known.limit(MOST_PHASES + 1).groupBy("_k").count().agg(F.sum("count").alias("n"), F.max("count").alias("of")).first()
    if (few["n"] or 0) <= MOST_PHASES and (few["of"] or 0) <= MOST_OF_KEY:
        return _broadcast(rows, known, key, at)
    return _sorted(rows, known, key, at)


def _broadcast(rows: DataFrame, known: DataFrame, key: str, at: str) -> DataFrame:
    along = Window.partitionBy("_k").orderBy("_o")
    spans = known.select("_k", F.lag("_o").over(along).alias("_after"), F.when(F.lead("_o").over(along).isNotNull(), F.col("_o")).alias("_till"), "_v")
    time = F.coalesce(F.col(at), F.lit(_FIRST))
    within = (F.col(key) == F.col("_k")) & (F.col("_after").isNull() | (time > F.col("_after"))) & (F.col("_till").isNull() | (time <= F.col("_till")))
    return rows.join(F.broadcast(spans), within, "left").select(*(rows[c] for c in rows.columns), "_v.*")


def _sorted(rows: DataFrame, known: DataFrame, key: str, at: str) -> DataFrame:
    given = F.struct(*rows.columns)
    kind = rows.select(given.alias("r")).schema["r"].dataType
    both = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.coalesce(F.col(at), F.lit(_FIRST)).alias("_o"), F.lit(0).alias("_side"), F.xxhash64(*rows.columns).alias("_salt"), given.alias("_r"), F.lit(None).cast(known.schema["_v"].dataType).alias("_v"))
    both = both.unionByName(known.select("_k", "_o", F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_salt"), F.lit(None).cast(kind).alias("_r"), "_v"))
    order = ["_k", "_o", "_side", "_salt"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(both.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "asof")

    phase = F.when(F.col("_side") == 1, F.struct("_o", "_v"))
    pieces = placed.groupBy("_k", "_part").agg(F.min(phase).alias("first"), F.max(phase).alias("last"))
    later = Window.partitionBy("_k").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_k", "_part", F.last("first", ignorenulls=True).over(later).alias("next"), F.max("last").over(Window.partitionBy("_k")).alias("last"))
    back = Window.partitionBy("_k", "_part").orderBy(F.desc("_o"), F.desc("_side"), F.desc("_salt")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumn("_own", F.last("_v", ignorenulls=True).over(back)).where("_side = 0")
    met = own.join(pieces, ["_k", "_part"]).select("_r.*", F.coalesce("_own", "next._v", "last._v").alias("_v"))
    nameless = rows.where(F.col(key).isNull()).select("*", F.lit(None).cast(known.schema["_v"].dataType).alias("_v"))
    return met.unionByName(nameless).select(*rows.columns, "_v.*")
