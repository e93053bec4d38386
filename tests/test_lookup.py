"""The lookup table: what it returns, and what its plan reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from dubsar.sources import lookup


def test_lookup_reads_one_bucket(spark, tmp_path):
    df = spark.range(20_000).select(F.concat(F.lit("P"), F.col("id")).alias("tablet_id"), (F.col("id") * 2).alias("v"), F.lit(7).alias("_x"))
    table = lookup.write(df, str(tmp_path / "t"), "tablet_id", rows=1_000)
    again = lookup.Lookup(spark, str(tmp_path / "t"), "tablet_id")
    for t in (table, again):
        assert t.rows.columns == df.columns and t.rows.count() == 20_000
        assert [tuple(r) for r in t.at("P777").collect()] == [("P777", 1554, 7)]
        assert t.at("none").collect() == [] and t.at("P'\"\\").collect() == []
    own = table.at("P777")
    assert len({r["f"] for r in table.rows.select(F.input_file_name().alias("f")).distinct().collect()}) == 20
    own.collect()
    plan = spark._jvm.PythonSQLUtils.explainString(own._jdf.queryExecution(), "formatted")
    assert "EqualTo(tablet_id,P777)" in plan and "PartitionFilters: [isnotnull(_buckets" in plan
    scan = own._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().apply("numFiles").value() if scan.metrics().contains("numFiles") else 1
    assert read <= 1


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "tablet_id string, v int")
    assert lookup.write(none, str(tmp_path / "t"), "tablet_id").at("x").collect() == []
