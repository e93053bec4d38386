"""Double-booked records: an equi-join on date and total with an overlap of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dubsar.functions.columns import listed, matches, strip

KEYS = ["ruler", "regnal_year", "month", "day", "total_animals"]


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def anchored(flat: DataFrame, pos: str = "pos") -> DataFrame:
    """Records fixed in time and count, with name lists. flat carries pos, the place in input order."""
    total = strip(F.col("total_animals_resolved"))
    rows = flat.select(
        F.col(pos).alias("pos"), "tablet_id", "designation", strip(F.col("ruler")).alias("ruler"), strip(F.col("regnal_year")).alias("regnal_year"),
        strip(F.col("month_number")).alias("month"), strip(F.col("day")).alias("day"), F.when(matches(total, r"^[+-]?\d+$"), total.try_cast("long")).alias("total_animals"),
        "total_animals_status", F.col("transaction_type").alias("tx"), listed(F.col("source_normalized"), lower=True).alias("src"), listed(F.col("receiver_normalized"), lower=True).alias("rcv"), total.alias("_t"),
    )
    full = (F.col("ruler") != "") & (F.col("regnal_year") != "") & (F.col("month") != "") & (F.col("day") != "")
    return rows.where(full & (F.col("total_animals_status") != "incomplete") & F.col("total_animals").isNotNull() & (F.col("_t") != "0")).drop("_t", "total_animals_status")


def link(flat: DataFrame, pos: str = "pos") -> DataFrame:
    """Pairs a before b in input order that share date, total and a source or a receiver.

    One name per row and side is joined with the key, so that a frequent date and total
    costs its name matches only, not the square of its rows; a pair that several names
    share is then one row again.
    """
    rows = anchored(flat, pos)
    named = rows.select("*", F.explode(F.array_union(F.transform("src", lambda n: F.struct(F.lit("s").alias("side"), n.alias("name"))), F.transform("rcv", lambda n: F.struct(F.lit("r").alias("side"), n.alias("name"))))).alias("by"))
    own = ["pos", "tablet_id", "designation", "tx"]
    a = named.select(*KEYS, "by", *(F.col(c).alias(f"{c}_a") for c in own))
    b = named.select(*KEYS, "by", *(F.col(c).alias(f"{c}_b") for c in own))
    joined = a.join(b, [*KEYS, "by"]).where(F.col("pos_a") < F.col("pos_b"))
    pairs = joined.groupBy(*KEYS, *(f"{c}_{s}" for s in "ab" for c in own)).agg(F.bool_or(F.col("by.side") == "s").alias("src_match"), F.bool_or(F.col("by.side") == "r").alias("rcv_match"))
    anchors = F.filter(F.array(F.lit("date"), F.lit("quantity"), F.when(F.col("src_match"), "source"), F.when(F.col("rcv_match"), "receiver")), lambda x: x.isNotNull())
    flag = lambda c: F.when(F.col(c), "1").otherwise("0")
    return pairs.select(
        F.col("tablet_id_a").alias("tablet_a"), F.col("tablet_id_b").alias("tablet_b"), "designation_a", "designation_b", *KEYS, "tx_a", "tx_b",
        flag("src_match").alias("source_match"), flag("rcv_match").alias("receiver_match"), F.array_join(anchors, "|").alias("anchors_matched"), F.size(anchors).alias("match_strength"), "pos_a", "pos_b",
    )


def ranked(pairs: DataFrame) -> DataFrame:
    """Strongest first, then by id as text, then input order."""
    return pairs.orderBy(F.desc("match_strength"), "tablet_a", "pos_a", "pos_b")
