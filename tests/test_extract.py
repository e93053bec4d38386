"""Literal lines with known outcomes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dubsar.functions import atf
from dubsar.operators import annotate, extract, flatten, issues, linkage, names
from dubsar.sources import readers


def tablet(*lines: str) -> str:
    return "@tablet\n@obverse\n" + "\n".join(f"{i}. {x}" for i, x in enumerate(lines, 1))


ANIMALS = {
    "3(u) 2(disz) udu": [(32, "udu", [], False)],
    "1(gesz2) la2 1(disz) gu4": [(59, "gu4", [], False)],
    "3(u) la2 1(disz) sila4": [(29, "sila4", [], False)],
    "2(disz) gu4 siki ge6-[ge6]": [],
    "3(disz) ad7 gu4": [(3, "gu4", ["ba-usz2"], False)],
    "5(u) 8(disz) ad7 udu u2": [(58, "udu", ["ba-usz2", "u2"], False)],
    "7(disz) ad6? masz2": [(7, "masz2", ["ba-usz2"], False)],
    "gu4 ki ur-{d}ba-ba6 dub-sar-ta": [(1, "gu4", [], False)],
    "udu ba-usz2": [],
    "1(u)5(disz) udu": [],
    "1/2(disz) udu": [(2, "udu", [], False)],
    "[x] udu niga": [(1, "udu", ["niga"], True)],
    "5(disz)# masz2": [(5, "masz2", [], True)],
    "1(disz) udu niga 2(disz) sila4 ga": [(1, "udu", ["niga", "ga"], False), (2, "sila4", ["ga"], False)],
    "1(disz) amar masz-da3 ga": [(1, "amar masz-da3", ["ga"], False)],
    "1(disz) masz2-e": [],
    "1(disz) uz-ga": [],
}
PERSONS = {
    "ki na-sa6-ta": [("na-sa6", "source", "")],
    "ki lugal-ku3-zu ensi2 esz3-nun-na{ki}-ta": [("lugal-ku3-zu ensi2 esz3-nun-na{ki}", "source", "ensi2")],
    "ur-nigar{gar} szu ba-ti": [("ur-nigar{gar}", "receiver", "")],
    "na-lu sukkal i3-dab5": [("na-lu", "receiver", "sukkal")],
    "giri3 da-da dub-sar": [("da-da", "intermediary", "dub-sar")],
    "da-da ra2-gaba maszkim": [("da-da", "commissioner", "ra2-gaba")],
    "kiszib3 lu2-kal-la": [("lu2-kal-la", "sealer", "")],
    "mu-kux(DU) a-hu-ni": [("a-hu-ni", "deliverer", "")],
    "mu-kux(DU) lugal": [],
    "zi-ga bala ensi2 umma{ki}": [("governor of umma{ki}", "source", "ensi2")],
    "bala lugal-ku3-zu ensi2": [("lugal-ku3-zu", "source", "ensi2")],
    "maszkim": [],
}


def test_lines_of_one_tablet_each(spark):
    cases = [*ANIMALS, *PERSONS]
    df = spark.createDataFrame([(str(i), tablet(c)) for i, c in enumerate(cases)], "id_text string, transliteration string")
    for r in extract.extract(df).collect():
        line = cases[int(r["tablet_id"])]
        if line in ANIMALS:
            assert [(a["count"], a["animal"], a["qualifiers"], a["damaged"]) for a in r["animals"]] == ANIMALS[line], line
        else:
            assert [(p["name"], p["role"], p["title"]) for p in r["persons"]] == PERSONS[line], line


@pytest.fixture(scope="module")
def whole(spark):
    texts = {
        "prev": tablet("2(disz) udu", "na-ra-am-i3-li2", "i3-dab5", "mu-[kux(DU) ... x]"),
        "seal": "@tablet\n1. 1(disz) udu\n@seal 1\n@column 1\n1. 9(disz) gu4\n@reverse\n. iti diri ezem-mah ba-zal\n@left\n1. 5(disz)\n1. 2(disz)-kam",
        "sum": tablet("3(disz) udu", "szu-nigin 3(disz) udu", "[x] gu4", "sza3-bi-ta", "zi-ga"),
        "impute": tablet("3(disz) udu", "[x] gu4") + "\n@left\n1. 1(u)",
        "gods": tablet("1(disz) udu {d}en-lil2", "ur-{d}nanna", "e2-{d}utu", "u4 2(disz)-kam", "mu us2-sa {d}inanna"),
        "blank": "   ",
        "none": None,
    }
    df = spark.createDataFrame([(k, v, "Amar-Suen.09.12d.07 (us2 year)") for k, v in texts.items()], "id_text string, transliteration string, date_of_origin string")
    return extract.extract(df).persist()


def one(df, key):
    return df.where(F.col("tablet_id") == key).first()


def test_previous_line_and_damaged_delivery(whole):
    r = one(whole, "prev")
    assert r["transaction_type"] == "delivery"
    assert ("na-ra-am-i3-li2", "receiver") in [(p["name"], p["role"]) for p in r["persons"]]


def test_seal_and_left_edge_are_no_content(whole):
    r = one(whole, "seal")
    assert [x["clean"] for x in r["lines"]] == ["1(disz) udu", "iti diri ezem-mah ba-zal"]
    assert (r["edge_total"], r["month_name"], r["total_animals"]) == (5, "diri ezem-mah", 1)
    assert (r["ruler"], r["regnal_year"], r["month_number"]) == ("Amar-Suen", 9, 12)


def test_summary_mode_counts_the_broken_entry(whole):
    r = one(whole, "sum")
    assert (r["total_animals"], r["has_summary_line"], r["has_sza3_bi_ta"], r["total_animals_status"], r["transaction_type"]) == (4, True, True, "incomplete", "sub_disbursement")


def test_imputation_from_the_edge(whole):
    r = one(whole, "impute")
    assert (r["total_animals_status"], r["total_animals_resolved"], r["imputation_target"]) == ("imputed", 10, "gu4")
    assert "[imp:7]×gu4" in one(flatten.to_flat(whole), "impute")["animals_detail"]


def test_recipients_stand_alone(whole):
    assert one(whole, "gods")["divine_recipients"] == ["{d}en-lil2", "{d}utu"]
    assert one(whole, "gods")["day"] == "2"


def test_blank_and_null_texts_have_only_a_date(whole):
    for key in ("blank", "none"):
        r = one(whole, key)
        assert (r["lines"], r["total_animals"], r["extraction_score"], r["damage"]["preservation"], r["total_animals_status"]) == ([], 0, "none", 1.0, "complete")
        assert r["regnal_year"] == 9


def test_flat_record_has_44_columns(whole):
    assert flatten.to_flat(whole).columns == flatten.FLAT_COLUMNS and len(flatten.FLAT_COLUMNS) == 44


def test_issues(spark):
    df = spark.createDataFrame([("a", tablet("3(disz) zzz", "5(disz) sila3 i3", "u4 3(disz)-kam"))], "id_text string, transliteration string")
    assert [(r["type"], r["severity"], r["line"]) for r in issues.issues(extract.extract(df)).orderBy("seq").collect()] == [("unrecognized_after_numeral", "warning", "3(disz) zzz"), ("no_transaction", "info", "")]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(atf.without_damage(lit("a[b#] <c> <<d>>  e?!\tf"))) == "ab c e f"
    assert one(atf.animal_base(lit("masz2-gal-niga"))) == "masz2" and one(atf.animal_base(lit("{ansze}kunga2"))) == "{ansze}kunga2" and one(atf.animal_base(lit("amar masz-da3"))) == "amar"
    assert one(atf.to_ascii(lit("šu-{d}šara₂ ṭ"))) == "szu-{d}szara2 t,"
    assert one(atf.normal_tablet_id(lit("P000123"))) == "123" and one(atf.normal_tablet_id(lit("p"))) == "0"
    assert one(atf.period_label(lit("Amar-Suen"), lit(5))) == "AS.05" and one(atf.period_label(lit("X"), lit(5))) == "X.5"
    assert one(F.size(atf.parsed_animals(lit("3×udu-niga, [imp:7]×gu4, x")))) == 2
    assert one(atf.deity_category(lit("{d}Inanna"))) == "uruk" and one(atf.destination_group(lit("nibru{ki}"))) == "city"
    assert one(atf.meaning_category(lit("box"))) == "animal" and one(atf.meaning_category(lit("head Scribe"))) == "profession"
    assert one(atf.without_case_suffix(lit("na-sa6-ta"))) == "na-sa6"
    assert [one(atf.date_not_after(lit("AS"), lit(9), lit(m), ("AS", 9, 7))) for m in (0, 7, 8)] == [True, True, False]
    assert one(atf.flow_matches(lit("receipt"), "external")) is False and one(atf.flow_matches(lit("delivery"), "in"))


def test_annotation_roles(spark):
    df = spark.createDataFrame([("a", tablet("5(disz) udu niga x", "ki na-sa6-ta", "ur-mes szu ba-ti", "mu us2-sa {d}nanna ba-hul"))], "id_text string, transliteration string")
    table = annotate.token_table(annotate.annotate(extract.extract(df))).where("role <> 'line_number' and line >= 2").orderBy("line", "seq").collect()
    roles = [(r["text"], r["role"]) for r in table]
    assert roles == [("5(disz)", "numeral"), ("udu", "animal"), ("niga", "qualifier"), ("x", "damage"), ("ki", "role_marker"), ("na-sa6", "person"), ("-ta", "role_marker"), ("ur-mes", "person"), ("szu", "transaction"), ("ba-ti", "transaction"), ("mu", "structural_keyword"), ("us2-sa", "text"), ("{d}nanna", "year_text"), ("ba-hul", "text")]


def test_name_lookup_falls_back_in_order(spark):
    known = spark.createDataFrame([("na-sa6", "Nasa", "PN", "personal_name", 3)], names.NAMES)
    asked = spark.createDataFrame([("na-sa6",), ("na-sa₆-ta",), ("[na]-sa6#-e",), ("zz",)], "name string")
    assert {r["name"]: r["canonical"] for r in names.look_up(asked, known).collect()} == {"na-sa6": "Nasa", "na-sa₆-ta": "Nasa", "[na]-sa6#-e": "Nasa", "zz": None}


def test_links_keep_order_and_overlap(spark):
    base = {c: "" for c in flatten.FLAT_COLUMNS}
    row = lambda k, src, rcv: base | {"tablet_id": k, "ruler": "r", "regnal_year": "1", "month_number": "2", "day": "3", "total_animals_resolved": "7", "total_animals_status": "complete", "source_normalized": src, "receiver_normalized": rcv, "pos": int(k)}
    df = spark.createDataFrame([row("1", "A; b", "x"), row("2", "B", "X"), row("3", "q", "z"), row("4", "", "z")], ", ".join(f"{c} string" for c in flatten.FLAT_COLUMNS) + ", pos long")
    got = [(r["tablet_a"], r["tablet_b"], r["anchors_matched"]) for r in linkage.ranked(linkage.link(df)).collect()]
    assert got == [("1", "2", "date|quantity|source|receiver"), ("3", "4", "date|quantity|receiver")]


def test_csv_zip_and_stream_round_trips(spark, tmp_path):
    import json
    import zipfile

    path = str(tmp_path / "t.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('id_text,transliteration\n1,"@tablet\n1. 3(disz) udu ""x"""\n2,\n1,"@tablet\n1. 4(disz) udu"\n')
    rows = readers.read_tablets(spark, path)
    assert rows.count() == 3 and {(r["id_text"], r["transliteration"][-10:]) for r in readers.with_text(rows).collect()} == {("1", "(disz) udu"[-10:])}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/corpusjson/P1.json", json.dumps({"cdl": [{"node": "c", "cdl": [{"node": "l", "f": {"form": "šu", "cf": "Shu", "pos": "PN"}}]}]}))
        z.writestr("a/corpusjson/P2.json", "not json")
    built = names.build_names(names.walk_lemmas(readers.read_zip_members(spark, str(tmp_path / "z.zip"))))
    assert {r["form"] for r in built.collect()} == {"šu", "szu"}
    from dubsar.streaming.tablets import extract_stream, read_stream

    rows.select("id_text", "designation", "transliteration", "date_of_origin").write.parquet(str(tmp_path / "in"))
    extract_stream(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
