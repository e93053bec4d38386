"""What the making of texts deals out and stores is no more than it must be, and says the same."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dubsar.operators import extract as x
from dubsar.sources import synthetic

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"


def test_odd_marks_are_dealt_out_as_one_number(spark, tmp_path):
    flags, states, types = ("R", "A", "N", "", None), ("F", "O", None), (*synthetic.SPECIES, "OTHER", None)
    rows = [(k, p, 13 if k % 3 else 7, 1 + k % 7, float(1 + k % 9), r, s) for k, (p, r, s) in enumerate((p, r, s) for p in range(len(types)) for r in flags for s in states)]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(list(enumerate(types)), "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    line, part = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("lineitem", "part"))
    said = line.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("n", F.col("l_quantity").cast("bigint"))
    said = said.withColumns({"kind": F.expr(synthetic.ITEM_KIND), "species": F.expr(synthetic.ITEM_SPECIES), "qualifier": F.expr(synthetic.ITEM_QUALIFIER)}).withColumn("dead", F.expr(synthetic.ITEM_DEAD))
    told = synthetic.items(spark, str(tmp_path))
    assert "told" in told.columns
    columns = ["l_orderkey", "l_linenumber", "n", "kind", "species", "qualifier", "dead"]
    got, want = (sorted(map(tuple, df.select(columns).collect()), key=str) for df in (told, said))
    assert got == want and len(got) == len(rows)


def test_a_line_is_stored_once(spark, monkeypatch):
    kept, stored = {}, x.stored
    monkeypatch.setattr(x, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    text = "@tablet\n@obverse\n1. 2(disz) udu\n2. ki na-sa6-ta\n3. ur-mes\n4. szu ba-ti\n"
    tablets = spark.createDataFrame([(str(k), text) for k in range(3)], "id_text string, transliteration string")
    got = x.extract_tablets(tablets).select("tablet_id", "persons", "total_animals").collect()
    assert kept["texts"].schema["content"].dataType.elementType.names == ["raw", "later", "numbered"]
    want = x.extract(tablets).select("tablet_id", "persons", "total_animals").collect()
    assert sorted(got) == sorted(want) and [p["name"] for p in got[0]["persons"]] == ["na-sa6", "ur-mes"] and math.isclose(got[0]["total_animals"], 2)
