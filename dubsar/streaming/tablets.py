"""Extraction over a stream of tablets: stateless per row, so the batch plan runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dubsar.operators.extract import extract
from dubsar.operators.flatten import to_flat

SCHEMA = "id_text string, designation string, transliteration string, date_of_origin string"


def read_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def extract_stream(tablets: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Flat records appended to Parquet as tablets arrive; exactly once, by the file sink's log."""
    return to_flat(extract(tablets)).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
