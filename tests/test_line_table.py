"""Extraction over the table of distinct lines against extraction within the row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dubsar.operators import extract
from dubsar.sources.scratch import shared_table
from dubsar.sources.synthetic import tablets

SCHEMA = "id_text string, designation string, transliteration string, date_of_origin string, row int, facts string"
LINES = [
    "6(disz) ab2", "gu4", "[x] udu niga", "ki ur-{d}nanna-ta", "ki lu2-sa6", "zi-ga lugal", "na-sa6", "szu ba-ti", "in-ta-e3-a szu ba-ti", "i3-dab5", "zabar-dab5", "szu [ba]-ti", "mu-kux(DU) lugal",
    "mu-[kux(DU) x]", "szu-nigin 5(u) udu", "5(u) nigin2-ba", "iti masz-da3-gu7", "mu en-{d}inanna ba-hun", "u4 5(disz)-kam", "{d}en-lil2-sze3", "e2-muhaldim-sze3", "giri3 ur-ku3 dub-sar", "la2-ia3 2(disz) masz2",
    "2(disz) la2 1(disz)", "sza3-bi-ta", "ur  x", "3(disz)# udu?", "<<ki>> x-ta", "iti", "lugal ur-{d}nanna", "bala ensi2 umma{ki}",
]
MARKS = ["@obverse", "@reverse", "@left", "@LEFT", "@seal 1", "@column 1", "&P1 = x", "$ 2 lines broken", "$ rest missing", "", "#lem: x", ". gu4", ".  2(disz) udu", "1.", "1'. sila4", "  7.  2(u) masz2  ", "@sealed", "@left side"]


def _texts(n: int) -> list[str | None]:
    rng = random.Random(11)
    out: list[str | None] = [None, "", "@tablet", "1. gu4", "x" * 10_000, "@left\n1. 5(disz)\n@left\n2. 6(disz)\n@edge\n@left\n3. 7(disz)"]
    for _ in range(n):
        out.append("\n".join(f"{i + 1}. {rng.choice(LINES)}" if rng.random() < 0.7 else rng.choice(MARKS) for i in range(rng.randint(1, 25))))
    return out


def _told(df) -> list[str]:
    return sorted(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toPandas()["j"])


@pytest.mark.parametrize("hot", [1 / 2000, 2.0])
def test_line_table_equals_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(extract, "HOT", hot)  # at 2.0 no line is hot
    rows = [(str(i // 2), "d", t, "AS.05.03.00", i, "clash") for i, t in enumerate(_texts(150))]
    rows.append(rows[9])
    given = spark.createDataFrame(rows, SCHEMA)
    got = extract.extract_tablets(given)
    want = extract.extract(given)
    assert got.columns == want.columns and _told(got) == _told(want)


def test_empty_table(spark):
    assert extract.extract_tablets(spark.createDataFrame([], SCHEMA)).collect() == []


def test_each_distinct_line_is_read_once(spark, sf_dir, monkeypatch):
    kept = {}
    real = extract.stored
    monkeypatch.setattr(extract, "stored", lambda df, name: kept.setdefault(name, real(df, name)))
    extract.extract_tablets(tablets(spark, sf_dir))
    facts = kept["lines"]
    n, distinct, said = facts.agg(F.count("*"), F.count_distinct("id"), F.sum("n")).first()
    assert n == distinct and said > 3 * n


def test_lines_stay_with_their_texts(spark, sf_dir):
    """No text or line is dealt out once the texts are stored: at 360 times sf0.1 that shuffle was beyond the limit."""
    plan = extract.extract_tablets(tablets(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_items_are_gathered_behind_one_shuffle(spark, sf_dir):
    """No aggregate gathers items where they are read, and no text of theirs is dealt out: at 60 times sf0.1 that spilled."""
    plan = tablets(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    behind = plan[plan.index("hashpartitioning(l_orderkey") :]
    assert "concat_ws" not in behind and "concat_ws" in plan


def test_orders_without_items_and_repeated_items(spark, tmp_path):
    """Ties among items are read by their text; an order without items has lines of its reverse alone."""
    spark.sql("SELECT * FROM VALUES (1L, 5L, 'O', timestamp'1995-02-03', '3-MEDIUM'), (2L, 5L, 'O', timestamp'1995-02-03', '3-MEDIUM') AS t(o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (9L, 'STANDARD') AS t(p_partkey, p_type)").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 9L, 1L, 2, 4D, 'R', 'O'), (1L, 9L, 1L, 1, 3D, 'R', 'O'), (1L, 9L, 1L, 1, 3D, 'A', 'O'), (7L, 9L, 1L, 1, 3D, 'A', 'O') AS t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, l_linestatus)").write.parquet(f"{tmp_path}/lineitem.parquet")
    told = {r["id_text"]: r["transliteration"].split("\n") for r in tablets(spark, str(tmp_path)).collect()}
    assert told["1"][3:6] == ["1. 3(disz) udu niga", "2. 3(disz) udu u2", "3. 4(disz) udu niga"]
    assert told["1"][6] == told["2"][3] == "@reverse" and len(told) == 2


def test_shared_table_finds_rows(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "b", 2), ('"\\\n š', "b", 3)], "k string, p string, v int")
    find = shared_table(rows, "k", "p")
    asked = rows.select("k", "p").unionByName(spark.createDataFrame([("b", None), ("", "b")], "k string, p string"))
    got = asked.select("k", "p", F.transform(F.array("k"), lambda k: find(k, F.col("p"))["v"])[0].alias("v")).collect()
    assert {(r["k"], r["p"]): r["v"] for r in got} == {("a", None): 1, ("a", "b"): 2, ('"\\\n š', "b"): 3, ("b", None): None, ("", "b"): None}
    none = shared_table(rows.where("false"), "k", "p")
    assert rows.select(none(F.col("k"), F.col("p")).alias("r")).where("r is not null").count() == 0
