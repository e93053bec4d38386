"""The flat 44-column record of a tablet, all strings, as a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dubsar.operators.extract import with_role

# Fixed value: the columns of the flat record, in order.
FLAT_COLUMNS = ["tablet_id", "designation", "date_of_origin", "ruler", "regnal_year", "month_number", "day", "transaction_type", "source", "receiver", "intermediary", "commissioner", "sealer", "deliverer", "source_normalized", "receiver_normalized", "intermediary_normalized", "commissioner_normalized", "source_title", "receiver_title", "intermediary_title", "source_office", "receiver_office", "animals_detail", "total_animals", "total_animals_certain", "total_animals_uncertain", "total_animals_resolved", "total_animals_status", "imputation_method", "imputation_target", "edge_total", "has_summary_line", "has_sza3_bi_ta", "divine_recipients", "destination", "destination_category", "month_name", "year_name", "has_transliteration", "extraction_score", "preservation_score", "damaged_signs", "broken_signs"]


def joined(people: Column, role: str, of) -> Column:
    return F.array_join(F.transform(with_role(people, role), of), "; ")


def animal_label(a: Column) -> Column:
    """count×animal-qualifiers; an inferred count stands as [imp:n]."""
    count = F.when(a["is_imputed"], F.concat(F.lit("[imp:"), a["imputed_count"].cast("string"), F.lit("]"))).otherwise(a["count"].cast("string"))
    return F.concat(count, F.lit("×"), a["animal"], F.when(F.size(a["qualifiers"]) > 0, F.concat(F.lit("-"), F.array_join(a["qualifiers"], "-"))).otherwise(""))


def to_flat(extracted: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """The 44 columns, and after them those of extracted that are carried along."""
    people = F.col("persons")
    text = lambda c: F.col(c).cast("string")
    nonzero = lambda c: F.when(F.col(c) == 0, "").otherwise(F.col(c).cast("string"))
    flag = lambda c: F.when(F.col(c), "1").otherwise("0")
    made = {
        **{r: joined(people, r, lambda p: p["name"]) for r in ("source", "receiver", "intermediary", "commissioner", "sealer", "deliverer")},
        **{f"{r}_normalized": joined(people, r, lambda p: F.when(p["normalized_name"] != "", p["normalized_name"]).otherwise(p["name"])) for r in ("source", "receiver", "intermediary", "commissioner")},
        **{f"{r}_title": F.array_join(F.filter(F.transform(with_role(people, r), lambda p: p["title"]), lambda t: t != ""), "; ") for r in ("source", "receiver", "intermediary")},
        **{c: nonzero(c) for c in ("regnal_year", "month_number", "edge_total")},
        **{c: flag(c) for c in ("has_summary_line", "has_sza3_bi_ta", "has_transliteration")},
        "animals_detail": F.array_join(F.transform("animals", animal_label), ", "),
        "total_animals_resolved": F.when(F.col("total_animals_status") == "incomplete", "NaN").otherwise(text("total_animals_resolved")),
        "divine_recipients": F.array_join("divine_recipients", "; "),
        "preservation_score": text("damage.preservation"),
        "damaged_signs": text("damage.damaged_signs"),
        "broken_signs": text("damage.broken_signs"),
    }
    return extracted.select(*(made.get(c, text(c)).alias(c) for c in FLAT_COLUMNS), *carried)


def tablet_index(flat: DataFrame) -> DataFrame:
    """id, designation, date, tx, animals, confidence of records that have a text."""
    return flat.where("has_transliteration = '1'").select(
        F.col("tablet_id").alias("id"), "designation", F.col("date_of_origin").alias("date"), F.col("transaction_type").alias("tx"),
        F.coalesce(F.col("total_animals").try_cast("long"), F.lit(0)).alias("animals"), F.col("extraction_score").alias("confidence"),
    )
