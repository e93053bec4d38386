"""A synthetic tablet corpus over the star schema: one tablet per order, one line per lineitem.

The expressions here are SQL that Spark and DuckDB both run, so that an oracle can
compute what a tablet says from the relational columns, without parsing any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPECIES = {"STANDARD": "udu", "SMALL": "sila4", "MEDIUM": "masz2", "LARGE": "gu4", "ECONOMY": "ab2", "PROMO": "u8"}
SOURCES = ["na-sa6", "ab-ba-sa6-ga", "in-ta-e3-a", "lu2-dingir-ra", "ur-ku3-nun-na", "a-hu-ni", "szu-esz18-dar", "i-din-{d}da-gan", "nu-ur2-{d}iszkur", "lugal-ezem", "za-zi", "be-li2-du10"]
RECEIVERS = ["ur-nigar{gar}", "{d}szul-gi-a-a-mu", "na-lu", "en-lil2-la", "lugal-me-lam2", "du-ga", "nur-{d}suen", "in-ta-e3-a", "ur-mes", "i3-li2-an-dul3", "da-da", "zu-ba-ga"]
DELIVERERS = ["ur-mes" if n.startswith("lugal") else n for n in SOURCES]  # a name in lugal- would read as a royal delivery
DEITIES = ["{d}en-lil2", "{d}inanna", "{d}nanna"]
MONTHS = ["masz-da3-gu7", "ses-da-gu7", "u5-bi2-gu7", "ki-siki-{d}nin-a-zu", "ezem-{d}nin-a-zu", "a2-ki-ti", "ezem-{d}szul-gi", "szu-esz5-sza", "ezem-mah", "ezem-an-na", "ezem-me-ki-gal2", "sze-sag11-ku5"]


def pick(index: str, values: list[str], base: int = 0) -> str:
    """SQL for values[index]."""
    arms = " ".join(f"WHEN {k + base} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE {index} {arms} END"


def digits(n: str) -> str:
    """SQL for an integer below 600 in numeral signs, with la2 for nines."""
    tens, ones = f"(({n}) % 60 - ({n}) % 10) / 10", f"({n}) % 10"
    as_text = lambda x: f"CAST(CAST({x} AS INT) AS STRING)"
    return (
        f"trim(CASE WHEN ({n}) >= 60 THEN {as_text(f'(({n}) - ({n}) % 60) / 60')} || '(gesz2) ' ELSE '' END"
        f" || CASE WHEN {ones} = 9 AND {tens} BETWEEN 1 AND 4 THEN {as_text(f'{tens} + 1')} || '(u) la2 1(disz)'"
        f" ELSE CASE WHEN {tens} > 0 THEN {as_text(tens)} || '(u) ' ELSE '' END || CASE WHEN {ones} > 0 THEN {as_text(ones)} || '(disz)' ELSE '' END END)"
    )


#: What each lineitem becomes. n: quantity; kind: plain, damaged (#), lost ([x]), implied (no numeral) or derived (a product).
ITEM_KIND = """CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN 'lost' WHEN l_linenumber = 2 AND n = 1 THEN 'implied'
  WHEN l_suppkey % 50 = 13 THEN 'derived' WHEN l_linestatus = 'F' AND l_linenumber = 3 THEN 'damaged' ELSE 'plain' END"""
ITEM_SPECIES = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPECIES.items()) + " END"
ITEM_QUALIFIER = "CASE l_returnflag WHEN 'R' THEN 'niga' WHEN 'A' THEN 'u2' ELSE '' END"
ITEM_DEAD = "l_suppkey % 50 = 7 AND kind IN ('plain', 'damaged')"

#: What each order becomes.
ORDER_COLUMNS = {
    "y": "year(o_orderdate)",
    "m": "month(o_orderdate)",
    "d": "day(o_orderdate)",
    "ruler": "CASE WHEN year(o_orderdate) <= 1996 THEN 'Šulgi' WHEN year(o_orderdate) <= 1998 THEN 'Amar-Suen' WHEN year(o_orderdate) <= 2000 THEN 'Šū-Suen' ELSE 'Ibbi-Suen' END",
    "reign": "CASE year(o_orderdate) WHEN 1995 THEN 46 WHEN 1996 THEN 47 WHEN 1997 THEN 8 WHEN 1998 THEN 9 WHEN 1999 THEN 1 WHEN 2000 THEN 2 ELSE 1 END",
    "undated": "o_orderkey % 25 = 0",
    "blank": "o_orderkey % 257 = 5",
    "source": pick("o_custkey % 12", SOURCES),
    "receiver": pick("CAST((o_custkey - o_custkey % 12) / 12 AS BIGINT) % 12", RECEIVERS),
    "deliverer": pick("(o_custkey + 5) % 12", DELIVERERS),
    "urgent": "o_orderpriority = '1-URGENT'",
    "royal": "o_orderpriority = '1-URGENT' AND o_custkey % 7 = 0",
    "deity": f"CASE WHEN o_orderpriority = '2-HIGH' THEN {pick('o_custkey % 3', DEITIES)} ELSE '' END",
    "month_name": pick("month(o_orderdate)", MONTHS, 1),
    "with_edge": "o_orderkey % 3 = 0",
    "edge_error": "CASE WHEN o_orderkey % 9 = 0 THEN 3 ELSE 0 END",
    "with_summary": "o_orderkey % 20 = 3",
    "with_seal": "o_orderkey % 5 = 0",
    "with_break": "o_orderkey % 8 = 0",
    "with_giri": "o_orderkey % 4 = 0",
    "with_maszkim": "o_orderkey % 6 = 1",
    "with_kiszib": "o_orderkey % 10 = 2",
}


#: What the strings of a lineitem tell, as one number: place of the type in SPECIES (0 if none), return flag, line status.
_TOLD = f"""CASE p_type {" ".join(f"WHEN '{t}' THEN {6 * (k + 1)}" for k, t in enumerate(SPECIES))} ELSE 0 END
  + CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 4 ELSE 0 END + CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END"""
_RETOLD = {
    "p_type": pick("CAST((told - told % 6) / 6 AS INT)", list(SPECIES), 1), "l_returnflag": "CASE told % 6 - told % 2 WHEN 2 THEN 'R' WHEN 4 THEN 'A' END",
    "l_linestatus": "CASE told % 2 WHEN 1 THEN 'F' END",
}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem with what its line will say, the items of an order side by side.

    Dealt out by order are numbers alone; what they say is worked out behind that shuffle.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    line = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("n"), "l_returnflag", "l_linestatus")
    typed = line.join(read("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    dealt = typed.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "n", F.expr(_TOLD).alias("told")).repartition("l_orderkey")
    kinds = dealt.withColumns({k: F.expr(v) for k, v in _RETOLD.items()}).withColumns({"kind": F.expr(ITEM_KIND), "species": F.expr(ITEM_SPECIES), "qualifier": F.expr(ITEM_QUALIFIER)})
    return kinds.withColumn("dead", F.expr(ITEM_DEAD))


_ITEM_TEXT = f"""concat_ws(' ', CASE kind WHEN 'lost' THEN '[x]' WHEN 'implied' THEN NULL WHEN 'damaged' THEN {digits("n")} || '#' ELSE {digits("n")} END,
  CASE WHEN dead THEN 'ad7' END, species, CASE WHEN kind = 'derived' THEN 'siki' END, CASE WHEN qualifier <> '' THEN qualifier END)"""


#: The lines of the reverse, null where a tablet has none.
REVERSE = [
    f"CASE WHEN with_summary AND total > 0 THEN 'szu-nigin ' || {digits('total')} || ' udu' END",
    "'ki ' || source || '-ta'",
    """CASE WHEN royal THEN 'mu-kux(DU) lugal' WHEN urgent THEN 'mu-kux(DU) ' || deliverer WHEN o_orderstatus = 'F' THEN 'ba-zi'
       WHEN o_orderstatus = 'O' THEN receiver || ' i3-dab5' ELSE receiver || ' szu ba-ti' END""",
    "CASE WHEN with_giri THEN 'giri3 ' || receiver || ' dub-sar' END",
    "CASE WHEN with_maszkim THEN deliverer || ' sukkal maszkim' END",
    "CASE WHEN with_kiszib THEN 'kiszib3 ' || receiver END",
    "CASE WHEN deity <> '' THEN deity END",
    "CASE o_orderpriority WHEN '3-MEDIUM' THEN 'e2-muhaldim-sze3' WHEN '4-NOT SPECIFIED' THEN 'sza3 nibru{ki}' WHEN '5-LOW' THEN 'e2-gal-la ba-an-kux' END",
    "'iti ' || month_name",
    f"'u4 ' || {digits('d')} || '-kam'",
    "'mu en-{d}inanna ba-hun'",
]
EDGE = f"CASE WHEN with_edge AND total > 0 THEN {digits('total + edge_error')} END"


def tablets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id_text, designation, transliteration, date_of_origin, dates_referenced and pos, the place in file order."""
    lines = items(spark, sf_dir).select("l_orderkey", "n", F.struct("l_linenumber", "l_partkey", "l_suppkey", "n", F.expr(_ITEM_TEXT).alias("text")).alias("item"))
    # A window gathers what one sort has brought together. An aggregate would gather in the tasks that read too, where orders are scattered, and spill there.
    order = Window.partitionBy("l_orderkey")
    whole = order.orderBy("l_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = lines.select("l_orderkey", F.collect_list("item").over(whole).alias("items"), F.sum("n").over(whole).alias("total"), F.row_number().over(order.orderBy("l_orderkey")).alias("at"))
    held = told.where("at = 1").select("l_orderkey", F.sort_array("items").alias("items"), "total")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    full = orders.join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumns({k: F.expr(v) for k, v in ORDER_COLUMNS.items()})
    body = F.transform(F.coalesce("items", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,n:bigint,text:string>>")), lambda x: x["text"])
    reverse = F.filter(F.array(*(F.expr(x) for x in REVERSE)), lambda x: x.isNotNull())
    numbered = lambda arr: F.transform(arr, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    edge = F.when(F.expr(EDGE).isNotNull(), F.array(F.lit("@left"), F.concat(F.lit("1. "), F.expr(EDGE)))).otherwise(F.array().cast("array<string>"))
    rows = F.concat(
        F.array(F.lit("&P000 = synthetic"), F.lit("@tablet"), F.lit("@obverse")), numbered(body),
        F.when(F.col("with_break"), F.array(F.lit("$ 2 lines broken"))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("@reverse")), numbered(reverse),
        F.when(F.col("with_seal"), F.array(F.lit("@seal 1"), F.lit("1. ur-{d}nanna dub-sar"), F.lit("@edge"))).otherwise(F.array().cast("array<string>")), edge,
    )
    date = F.expr("CASE WHEN undated THEN '00.00.00.00' ELSE ruler || '.' || lpad(CAST(reign AS STRING), 2, '0') || '.' || lpad(CAST(m AS STRING), 2, '0') || '.' || lpad(CAST(d AS STRING), 2, '0') END")
    return full.select(
        F.col("o_orderkey").cast("string").alias("id_text"), F.concat(F.lit("T "), F.col("o_orderkey").cast("string")).alias("designation"),
        F.when(F.col("blank"), "").otherwise(F.array_join(rows, "\n")).alias("transliteration"), date.alias("date_of_origin"), date.alias("dates_referenced"), F.col("o_orderkey").alias("pos"),
    )


#: What every tablet is expected to say; field_accuracy_whole holds each field of each tablet against it.
EXPECTED = {
    "transaction_type": "transfer", "source_office": "Chief Official", "receiver_office": "Chief Official", "ruler": "Amar-Suen", "destination": "e2-muhaldim-sze3", "destination_category": "city",
    "source": "NA-SA6", "receiver": "na-lu", "commissioner": "ur-mes", "intermediary": "du-ga", "deliverer": "ur-mes", "total_animals": "20", "month_number": "7", "regnal_year": "0", "divine_recipients": "{d}Nanna",
}


#: DuckDB: the same facts from the columns alone.
ORACLE_BASE = f"""
items_ AS (
  SELECT *, ({ITEM_DEAD}) AS dead FROM (
    SELECT *, {ITEM_KIND} AS kind, {ITEM_SPECIES} AS species, {ITEM_QUALIFIER} AS qualifier FROM (
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT AS n, l_returnflag, l_linestatus, p_type
      FROM lineitem JOIN part ON l_partkey = p_partkey))
), lines_ AS (
  SELECT l_orderkey, count(*) AS n_items, sum(n)::BIGINT AS total, sum(len(string_split({_ITEM_TEXT}, ' ')))::BIGINT AS n_words,
         count(*) FILTER (kind = 'damaged') AS n_damaged, count(*) FILTER (kind = 'lost') AS n_lost, count(*) FILTER (kind = 'implied') AS n_implied
  FROM items_ GROUP BY 1
), tabs_ AS (
  SELECT *, CAST(o_orderkey AS STRING) AS tablet_id FROM (
    SELECT *, list_filter([{", ".join(REVERSE)}], lambda x: x IS NOT NULL) AS reverse, {EDGE} AS edge_text FROM (
      SELECT o.*, coalesce(n_items, 0) AS n_items, total, coalesce(n_words, 0) AS n_words, coalesce(n_damaged, 0) AS n_damaged, coalesce(n_lost, 0) AS n_lost, coalesce(n_implied, 0) AS n_implied,
             {", ".join(f"{v} AS {k}" for k, v in ORDER_COLUMNS.items())}
      FROM orders o LEFT JOIN lines_ ON o_orderkey = l_orderkey))
), entries_ AS (
  SELECT o_orderkey AS k, l_linenumber, l_partkey, l_suppkey, CASE WHEN kind IN ('lost', 'implied') THEN 1 ELSE n END AS n, n AS given, species, kind, kind IN ('lost', 'damaged') AS damaged, dead, qualifier
  FROM items_ JOIN tabs_ ON l_orderkey = o_orderkey WHERE NOT blank AND kind <> 'derived' AND (NOT with_summary OR kind = 'lost')
  UNION ALL
  SELECT o_orderkey, -1, 0, 0, total, total, 'udu', 'plain', false, false, '' FROM tabs_ WHERE NOT blank AND with_summary AND total > 0
), sums_ AS (
  SELECT k, count(*) AS n_entries, sum(n)::BIGINT AS total_animals, coalesce(sum(n) FILTER (NOT damaged), 0)::BIGINT AS certain, count(*) FILTER (damaged) AS n_bad FROM entries_ GROUP BY k
), facts_ AS (
  SELECT t.*, coalesce(n_entries, 0) AS n_entries, coalesce(total_animals, 0) AS total_animals, coalesce(certain, 0) AS certain, coalesce(n_bad, 0) AS n_bad,
         CASE WHEN blank OR edge_text IS NULL THEN 0 ELSE t.total + edge_error END AS edge,
         CASE WHEN undated THEN '' ELSE ruler END AS ruler_, CASE WHEN undated THEN 0 ELSE reign END AS reign_, CASE WHEN blank AND undated THEN 0 ELSE m END AS month_,
         CASE WHEN blank THEN '' WHEN royal THEN 'royal_delivery' WHEN urgent THEN 'delivery' WHEN o_orderstatus = 'F' THEN 'expenditure' WHEN o_orderstatus = 'O' THEN 'transfer' ELSE 'receipt' END AS tx,
         NOT blank AND NOT urgent AND o_orderstatus <> 'F' AS has_receiver
  FROM tabs_ t LEFT JOIN sums_ ON o_orderkey = k
), judged_ AS (
  SELECT *, CASE WHEN n_bad = 0 THEN 'complete' WHEN n_bad = 1 AND NOT (with_summary AND total > 0) AND edge > 0 AND edge - certain >= 1 THEN 'imputed' ELSE 'incomplete' END AS status,
         CASE WHEN blank THEN 1.0 ELSE round_even((1.0 - (n_damaged + n_lost)::DOUBLE / (n_words + list_sum(list_transform(reverse, lambda x: len(string_split(x, ' ')))) + CASE WHEN with_seal THEN 2 ELSE 0 END
           + CASE WHEN edge_text IS NULL THEN 0 ELSE len(string_split(edge_text, ' ')) END)) * CASE WHEN with_break THEN 1.0 - 0.15 ELSE 1.0 END, 3) END AS preservation
  FROM facts_
), done_ AS (
  SELECT *, CASE status WHEN 'complete' THEN total_animals WHEN 'imputed' THEN edge ELSE 0 END AS resolved,
         CASE WHEN blank THEN 'none' ELSE CASE WHEN score >= 3.0 THEN 'high' WHEN score >= 1.5 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END END AS confidence,
         CASE ruler_ WHEN 'Šulgi' THEN 0 WHEN 'Amar-Suen' THEN 1 WHEN 'Šū-Suen' THEN 2 WHEN 'Ibbi-Suen' THEN 3 ELSE -1 END AS r_idx,
         CASE ruler_ WHEN 'Šulgi' THEN 'Š' WHEN 'Amar-Suen' THEN 'AS' WHEN 'Šū-Suen' THEN 'ŠS' WHEN 'Ibbi-Suen' THEN 'IS' ELSE '' END || '.' || lpad(reign_::STRING, 2, '0') AS period
  FROM (SELECT *, (3 + CASE WHEN n_entries > 0 THEN 1 ELSE 0 END) * preservation * CASE WHEN total_animals > 0 AND 2 * (total_animals - certain) > total_animals THEN 0.8 ELSE 1.0 END AS score FROM judged_)
), contrib_ AS (
  SELECT species AS key, d.tablet_id AS tablet, CASE WHEN e.damaged AND d.status = 'imputed' THEN d.edge - d.certain ELSE e.n END AS n, d.period AS period_y, d.period || '.' || lpad(d.month_::STRING, 2, '0') AS period_m, d.tx, d.o_orderkey AS pos
  FROM entries_ e JOIN done_ d ON e.k = d.o_orderkey WHERE d.r_idx >= 0
), shipped_ AS (
  SELECT d.*, c.n FROM done_ d JOIN (SELECT pos, sum(n)::BIGINT AS n FROM contrib_ GROUP BY pos) c ON c.pos = d.o_orderkey WHERE c.n > 0
)
"""
