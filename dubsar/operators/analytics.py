"""Corpus statistics, contribution facts, timelines, drill-down, officials and their network."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dubsar.functions import atf
from dubsar.functions import lexicon as L
from dubsar.functions.columns import chain, lookup
from dubsar.operators.asof import as_of

LENSES = ("animal", "deity", "destination", "destcat")


def corpus_stats(extracted: DataFrame) -> DataFrame:
    """measure, key, value: tablets and animals in all, tablets by transaction and by confidence."""
    base = extracted.where("has_transliteration").select(
        "total_animals", F.when(F.col("transaction_type") == "", "unknown").otherwise(F.col("transaction_type")).alias("tx"), F.when(F.col("extraction_score") == "", "none").otherwise(F.col("extraction_score")).alias("confidence")
    )
    cubed = base.groupingSets([[], ["tx"], ["confidence"]], "tx", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("total_animals").alias("animals"), F.grouping_id().alias("g"))
    row = lambda m, k, v: F.struct(F.lit(m).alias("measure"), k.alias("key"), v.cast("long").alias("value"))
    all_ = F.array(row("total_tablets", F.lit(""), F.col("n")), row("total_animals", F.lit(""), F.coalesce("animals", F.lit(0))))
    rows = F.when(F.col("g") == 3, all_).when(F.col("g") == 1, F.array(row("by_transaction", F.col("tx"), F.col("n")))).otherwise(F.array(row("by_confidence", F.col("confidence"), F.col("n"))))
    return cubed.select(F.inline(rows))


def dated(extracted: DataFrame) -> DataFrame:
    """Tablets of a known ruler and a positive year, with ordinal and labelled periods."""
    year = atf.period_label(F.col("ruler"), F.col("regnal_year"))
    out = extracted.withColumn("r_idx", atf.ruler_index(F.col("ruler"))).where("r_idx >= 0 and regnal_year > 0").withColumn("period_y", year)
    month = F.when(F.col("month_number").between(1, 13), F.concat("period_y", F.lit("."), atf.two_digits(F.col("month_number"))))
    return out.withColumn("period_m", month)


def periods(extracted: DataFrame) -> DataFrame:
    """granularity, period, ord: the periods that occur, in ordinal order."""
    base = dated(extracted)
    years = base.select(F.lit("year").alias("granularity"), F.col("period_y").alias("period"), (F.col("r_idx") * 100 + F.col("regnal_year")).cast("long").alias("ord"))
    months = base.where("period_m is not null").select(F.lit("month").alias("granularity"), F.col("period_m").alias("period"), ((F.col("r_idx") * 100 + F.col("regnal_year")) * 100 + F.col("month_number")).cast("long").alias("ord"))
    return years.union(months).distinct()


def contributions(extracted: DataFrame) -> DataFrame:
    """lens, key, tablet, count, animal, tx, period_y, period_m, pos, seq: the fact table of all timelines.

    An entry counts for its base species; a tablet's total for each deity, its
    destination and the destination's category. extracted carries pos.
    """
    base = dated(extracted).where(F.size("animals") > 0)
    tx = F.when(F.col("transaction_type") == "", "unknown").otherwise(F.col("transaction_type"))
    counted = F.transform("animals", lambda a: F.struct(F.when(a["is_imputed"], a["imputed_count"]).otherwise(a["count"]).alias("count"), F.when(F.size(a["qualifiers"]) > 0, F.concat(a["animal"], F.lit("-"), F.array_join(a["qualifiers"], "-"))).otherwise(a["animal"]).alias("animal")))
    rows = base.select("pos", F.col("tablet_id").alias("tablet"), tx.alias("tx"), "period_y", "period_m", counted.alias("entries"), "divine_recipients", "destination", "destination_category")
    rows = rows.withColumn("total", F.aggregate("entries", F.lit(0).cast("long"), lambda acc, e: acc + e["count"]))
    one = lambda lens, key, count, animal: F.struct(F.lit(lens).alias("lens"), key.alias("key"), count.alias("count"), animal.alias("animal"))
    whole = lambda lens, key: one(lens, key, F.col("total"), F.lit(""))
    none = F.array().cast("array<struct<lens:string,key:string,count:bigint,animal:string>>")
    facts = F.concat(
        F.transform("entries", lambda e: one("animal", atf.animal_base(e["animal"]), e["count"], e["animal"])),
        F.when(F.col("total") > 0, F.transform("divine_recipients", lambda d: whole("deity", d))).otherwise(none),
        F.when((F.col("total") > 0) & (F.col("destination") != ""), F.array(whole("destination", F.col("destination")))).otherwise(none),
        F.when((F.col("total") > 0) & (F.col("destination_category") != ""), F.array(whole("destcat", F.col("destination_category")))).otherwise(none),
    )
    flat = rows.select("pos", "tablet", "tx", "period_y", "period_m", F.posexplode_outer(facts).alias("seq", "f")).where("seq is not null")
    return flat.select("f.lens", "f.key", "tablet", "f.count", "f.animal", "tx", "period_y", "period_m", "pos", "seq")


def passing(contrib: DataFrame, flow: str | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    out = contrib.where(atf.flow_matches(F.col("tx"), flow))
    gone = sorted(set(exclude))
    return out.where(~F.col("tablet").isin(*gone)) if gone else out


def category_of(lens: str) -> Callable[[Column], Column]:
    return {"animal": atf.animal_category, "deity": atf.deity_category, "destination": atf.destination_group}.get(lens, lambda c: c)


def timeline(contrib: DataFrame, lens: str = "animal", flow: str | None = None, exclude: Iterable[str] = (), category_fn: Callable[[Column], Column] | None = None, min_tablets: int | None = None) -> DataFrame:
    """Per key: category, totals, and per year and month sums, contributions and maxima.

    granularity year, month or total; "tablets" counts contributions. One pass by
    grouping sets; keys below min_tablets (2 for animals, else 1) go.
    """
    least = (2 if lens == "animal" else 1) if min_tablets is None else min_tablets
    kept = passing(contrib.where(F.col("lens") == lens), flow, exclude)
    grouped = kept.groupingSets([["key", "period_y"], ["key", "period_m"], ["key"]], "key", "period_y", "period_m").agg(
        F.sum("count").alias("total_count"), F.count(F.lit(1)).alias("tablets"), F.max("count").alias("max_count"), F.grouping_id().alias("g")
    )
    shaped = grouped.where("not (g = 2 and period_m is null)").select(
        "key", chain([(F.col("g") == 1, F.lit("year")), (F.col("g") == 2, F.lit("month"))], F.lit("total")).alias("granularity"),
        F.when(F.col("g") == 1, F.col("period_y")).when(F.col("g") == 2, F.col("period_m")).otherwise("").alias("period"), "total_count", "tablets", "max_count",
    )
    all_ = F.max(F.when(F.col("granularity") == "total", F.col("tablets"))).over(Window.partitionBy("key"))
    return shaped.withColumn("_all", all_).where(F.col("_all") >= least).drop("_all").withColumn("category", (category_fn or category_of(lens))(F.col("key")))


def timeline_totals(contrib: DataFrame, lens: str = "animal", flow: str | None = None, exclude: Iterable[str] = (), min_tablets: int | None = None) -> DataFrame:
    """granularity, period, total_count over surviving keys, tablets that match, and their ratio in tenths."""
    sums = timeline(contrib, lens, flow, exclude, min_tablets=min_tablets).where("granularity <> 'total'").groupBy("granularity", "period").agg(F.sum("total_count").alias("total_count"))
    animal = passing(contrib.where("lens = 'animal'"), flow, exclude)
    tablets = animal.select("tablet", "period_y", "period_m").distinct()
    seen = tablets.groupingSets([["period_y"], ["period_m"]], "period_y", "period_m").agg(F.count(F.lit(1)).alias("tablets"), F.grouping_id().alias("g"))
    seen = seen.where("not (g = 2 and period_m is null)").select(F.when(F.col("g") == 1, "year").otherwise("month").alias("granularity"), F.coalesce("period_y", "period_m").alias("period"), "tablets")
    both = seen.join(sums, ["granularity", "period"], "left").select("granularity", "period", F.coalesce("total_count", F.lit(0)).alias("total_count"), "tablets")
    return both.withColumn("ratio", F.bround(F.col("total_count") / F.col("tablets"), 1))


def top_contributors(contrib: DataFrame, lens: str = "animal", flow: str | None = None, exclude: Iterable[str] = (), k: int = 8) -> DataFrame:
    """The k largest contributions of each key; ties by the first place of the period within the key, then input order."""
    kept = passing(contrib.where(F.col("lens") == lens), flow, exclude).select("key", "tablet", "count", "animal", "tx", "period_y", "pos", "seq")
    firsts = contrib.where(F.col("lens") == lens).groupBy("key", "period_y").agg(F.min(F.struct("pos", "seq")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("count"), "first", "pos", "seq"))
    return kept.join(firsts, ["key", "period_y"]).withColumn("rank", rank).where(F.col("rank") <= k).select("key", "rank", "tablet", "count", "animal", "tx")


def transactions_by_period(contrib: DataFrame) -> DataFrame:
    """period, tx, tablets: unfiltered."""
    return contrib.where("lens = 'animal'").select("tablet", F.col("period_y").alias("period"), "tx").distinct().groupBy("period", "tx").agg(F.count(F.lit(1)).alias("tablets"))


def cell(contrib: DataFrame, key: str, period: str, granularity: str = "year", limit: int = 100, lens: str = "animal", flow: str | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    """The limit largest contributions of one key and period; total_count and total_tablets are of the whole cell."""
    column = "period_m" if granularity == "month" else "period_y"
    own = passing(contrib.where((F.col("lens") == lens) & (F.col("key") == key) & (F.col(column) == period)), flow, exclude)
    sums = own.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_count"), F.count(F.lit(1)).alias("total_tablets"))
    top = own.orderBy(F.desc("count"), "pos", "seq").limit(limit).select("tablet", "count", "animal", "tx", "pos", "seq")
    return top.join(F.broadcast(sums))  # sums is one row


def _phase_key(name: Column) -> Column:
    """Official -> key; officials whose role changed get one key per phase, by the tablet's date."""
    abbr = atf.ruler_abbreviation(F.col("ruler"))
    cases = []
    for who, phases in L.TENURE.items():
        steps = [(atf.date_not_after(abbr, F.col("regnal_year"), F.col("month_number"), end), F.lit(f"{who}#{office}")) for end, office, _ in phases]
        cases.append((name == who, chain(steps, F.lit(f"{who}#{phases[-1][1]}"))))
    known = [n for n in L.OFFICE_OF if n not in L.TENURE]
    return chain([*cases, (name.isin(*known), name)], F.lit(None).cast("string"))


def office_table() -> dict[str, tuple[str, str]]:
    """Key -> (office, branch), with one key per phase."""
    out = {n: o for n, o in L.OFFICE_OF.items() if n not in L.TENURE}
    return out | {f"{who}#{office}": (office, branch) for who, phases in L.TENURE.items() for _, office, branch in phases}


def _date_ordinal(r_idx: Column, year: Column, month: Column) -> Column:
    """One number that orders dates; a missing month comes first."""
    part = lambda c, most: F.least(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)), F.lit(most)).cast("long")
    return (r_idx.cast("long") * 1_000_000 + part(year, 999_999)) * 100 + part(month, 99)


def tenure_table(spark: SparkSession) -> DataFrame:
    """name, official (the key of a phase), until (ordinal of its last date, null where open) of every known official."""
    rank = {abbr: k for k, (_, abbr) in enumerate(L.RULERS)}
    ends = [(who, f"{who}#{office}", *((None,) * 3 if end is None else (rank[end[0]], *end[1:]))) for who, phases in L.TENURE.items() for end, office, _ in phases]
    rows = ends + [(who, who, None, None, None) for who in L.OFFICE_OF if who not in L.TENURE]
    given = spark.createDataFrame(rows, "name string, official string, r_idx int, year int, month int")
    return given.select("name", "official", F.when(F.col("r_idx").isNotNull(), _date_ordinal(F.col("r_idx"), F.col("year"), F.col("month"))).alias("until"))


def official_mentions(extracted: DataFrame, tenure: DataFrame | None = None) -> DataFrame:
    """tablet_id, seq, role, official, period and its ordinal: every mention of a known official in a dated tablet, by the phase of tenure (as tenure_table) that its date falls in."""
    at = _date_ordinal(F.col("r_idx"), F.col("regnal_year"), F.col("month_number"))
    base = dated(extracted).select("tablet_id", at.alias("at"), F.col("period_y").alias("period"), (F.col("r_idx") * 100 + F.col("regnal_year")).cast("long").alias("ord"), F.posexplode("persons").alias("seq", "p"))
    named = base.where(F.col("p.role").isin("source", "receiver", "intermediary")).select("tablet_id", "seq", F.col("p.role").alias("role"), F.col("p.name").alias("name"), "at", "period", "ord")
    met = as_of(named, tenure_table(extracted.sparkSession) if tenure is None else tenure, "name", "at", "until")
    return met.where("official is not null").select("tablet_id", "seq", "role", "official", "period", "ord")


def officials(extracted: DataFrame) -> DataFrame:
    """Activity of each official: mentions by role, distinct tablets, first and last period."""
    m = official_mentions(extracted)
    role = lambda r: F.count_if(F.col("role") == r).alias(f"as_{r}")
    per_tablet = m.groupBy("official", "tablet_id", "period", "ord").agg(*(role(r) for r in ("source", "receiver", "intermediary")))
    at = F.struct("ord", "period")
    per = per_tablet.groupBy("official").agg(*(F.sum(f"as_{r}").alias(f"as_{r}") for r in ("source", "receiver", "intermediary")), F.count(F.lit(1)).alias("total_tablets"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    table = office_table()
    return per.select(
        "official", F.substring_index("official", "#", 1).alias("atf_name"), lookup(F.col("official"), {k: v[0] for k, v in table.items()}).alias("office"), lookup(F.col("official"), {k: v[1] for k, v in table.items()}).alias("sub_office"),
        "as_source", "as_receiver", "as_intermediary", "total_tablets", F.col("lo.period").alias("first_period"), F.col("hi.period").alias("last_period"), F.col("lo.ord").alias("first_year_idx"), F.col("hi.ord").alias("last_year_idx"),
    ).withColumn("office_label", lookup(F.col("office"), L.OFFICE_LABELS))


def officials_by_period(extracted: DataFrame) -> DataFrame:
    """official, period, tablets."""
    return official_mentions(extracted).select("official", "period", "tablet_id").distinct().groupBy("official", "period").agg(F.count(F.lit(1)).alias("tablets"))


def ordered_officials(activity: DataFrame) -> DataFrame:
    return activity.orderBy(lookup(F.col("office"), {"C": 0, "D": 1, "S": 2, "X": 3}, 99), "sub_office", "first_year_idx", "official")


def edges(extracted: DataFrame) -> DataFrame:
    """source, target, count: tablets' pairs of known officials, strongest first."""
    base = dated(extracted)
    known = lambda role: F.filter(F.transform(F.filter("persons", lambda p: p["role"] == role), lambda p: _phase_key(p["name"])), lambda k: k.isNotNull())
    pairs = base.select(F.explode(known("source")).alias("source"), known("receiver").alias("r")).select("source", F.explode("r").alias("target"))
    return pairs.where(F.col("source") != F.col("target")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "source", "target")
