"""Tables that several queries share, written once to the session's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dubsar.sources.scratch import dealt_finely, shared_folder

_PATHS: dict[tuple[str, str], tuple[str, object]] = {}


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make() as a Parquet table, made at most once per application and name.

    The folder is that of sources.scratch.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _PATHS:
        path = f"{shared_folder(spark)}/dubsar-kept-{uuid.uuid4().hex}"
        with dealt_finely(spark):
            df = make()
            df.write.option("compression", "zstd").parquet(path)
        _PATHS[key] = (path, df.schema)
    path, schema = _PATHS[key]
    return spark.read.schema(schema).parquet(path)
