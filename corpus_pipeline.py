"""A corpus pipeline: quality rules, near-dedup, decontamination, secret scans, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept,
and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dubsar.llm import bpe, decontaminate, near_dedup, quality_rules, secret_scans
from dubsar.llm.queries import tokenizer_path
from dubsar.llm.shared import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document of smallest id stays."""
    return near_dedup.near_dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; the secrets that the ledger finds in them are replaced by tags."""
    return secret_scans.cleaned(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source with token count and digests of ids and decoded text."""
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("secret scans", secrets),
    ("byte-pair encoding", tokens),
]

#: Token ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
