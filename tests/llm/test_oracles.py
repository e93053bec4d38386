"""Queries of the subpackage against DuckDB."""

from __future__ import annotations

import pytest

from dubsar.llm.oracles import ORACLES
from dubsar.llm.queries import QUERIES
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(name, spark, duck, sf_dir):
    got, want = QUERIES[name](spark, sf_dir).toArrow().to_pandas(integer_object_nulls=True), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_toxicity_on_held_out_rows(spark, sf_dir):
    scored = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = scored.join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    assert hit > 0.97, hit
