"""Lines that differ in what decides nothing are told once."""

from __future__ import annotations

from pyspark.sql import functions as F

from dubsar.operators import annotate, extract
from dubsar.plans.store import kept
from dubsar.sources.scratch import dealt_finely
from tests.test_annotate_tablets import _extracted


def test_whole_phrases_do_not_look_back(spark):
    lines = {"ki na-sa6-ta": False, "ki na-[sa6]-ta": False, "na-lu szu ba-ti": False, "na-lu i3-dab5": False, "3(disz)# udu": False, "ki na-sa6": True, "szu ba-ti": True, "[szu] ba-ti#": True, "i3-dab5": True, "<i3>-dab5": True, "ki  na-sa6": True}
    got = spark.createDataFrame([(k,) for k in lines], "raw string").select("raw", extract.looks_back(F.col("raw")).alias("back")).collect()
    assert {r["raw"]: r["back"] for r in got} == lines


def test_rare_lines_are_hot_where_there_is_room(spark, monkeypatch):
    monkeypatch.setattr(extract, "HOT", 1 / 3)
    counted = spark.createDataFrame([("a", 1_000_000), ("b", 2), ("c", 1), ("d", 3), ("e", 2)], "raw string, n long")
    got = [r["raw"] for r in extract.most_frequent(counted).collect()]
    assert len(got) == 3 and set(got) < {"a", "b", "d", "e"} and {"a", "d"} < set(got)


def test_damage_names_no_more_people(spark):
    """A damaged line carries the people that it may name, not all of its tablet; where brackets part words it carries all."""
    text = "@tablet\n@obverse\n1. 3(disz)# udu\n2. [x] udu\n3. na-lu# x\n4. na-[lu x\n5. <na>-lu\n@reverse\n1. ki na-sa6-ta\n2. na-lu szu ba-ti"
    x = extract.extract(spark.createDataFrame([("1", "d", text, "AS.05.03.00", 1, "")], "id_text string, designation string, transliteration string, date_of_origin string, row int, facts string"))
    rows = annotate._prepared(x).select(F.inline("lines")).where("kind = 'content'").select("body", F.transform("people", lambda p: p["name"]).alias("who")).collect()
    assert {r["body"]: r["who"] for r in rows} == {
        "3(disz)# udu": [], "[x] udu": [], "na-lu# x": ["na-lu"], "na-[lu x": ["na-sa6", "na-lu"], "<na>-lu": ["na-sa6", "na-lu"], "ki na-sa6-ta": ["na-sa6"], "na-lu szu ba-ti": ["na-lu"],
    }


def test_counts_of_lines_equal_the_lines(spark):
    x = _extracted(spark)
    lines = annotate.annotate(x).select(F.explode("annotated").alias("x"))
    as_rows = lambda df: sorted(map(tuple, df.collect()))
    counts = annotate.line_counts(x).localCheckpoint()
    assert as_rows(counts.groupBy("type", "section").agg(F.sum("n").alias("n"))) == as_rows(lines.groupBy(F.col("x.type").alias("type"), F.col("x.section").alias("section")).agg(F.count("*").alias("n")))
    said = lambda df, n: df.groupBy("text", "role", "detail", "en", "nl", "damaged").agg(n.alias("n"))
    tokens = annotate.token_table(annotate.annotate(x))
    assert as_rows(said(counts.select("n", F.inline("tokens")), F.sum("n"))) == as_rows(said(tokens.where("role <> 'line_number'"), F.count("*")))
    assert counts.where("numbered").agg(F.sum("n")).first()[0] == tokens.where("role = 'line_number'").count()
    assert counts.agg(F.max("n")).first()[0] > 1


def test_sections_follow_heads(spark):
    text = "1. a\n@reverse\n1. b\n@seal 1\n1. c\n@column 2\n1. d\n@edge\n1. e\n@left\nx\n1. f\n@Obverse\n\n$ rest broken\n@seal 2\n@reverse\n@other\n1. g"
    got = [(r["section"], r["kind"], r["number"], r["body"]) for r in spark.range(1).select(F.inline(annotate.lines_of(F.lit(text)))).collect()]
    assert [g for g in got if g[1] != "structural"] == [
        ("obverse", "content", "1.", "a"), ("reverse", "content", "1.", "b"), ("seal", "content", "1.", "c"), ("column 2", "content", "1.", "d"), ("column 2", "content", "1.", "e"), ("left_edge", "content", "1.", "f"),
        ("obverse", "damage_note", "", ""), ("other", "content", "1.", "g"),
    ]


def test_work_is_dealt_to_several_tasks_a_core(spark):
    key = "spark.sql.files.maxRecordsPerFile"
    had = spark.conf.get(key)
    with dealt_finely(spark):
        assert int(spark.conf.get("spark.sql.files.minPartitionNum")) > spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == had and spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    seen = []
    kept(spark, "test-dealt-finely", lambda: seen.append(spark.conf.get(key)) or spark.range(3))
    assert seen == ["50000"]
