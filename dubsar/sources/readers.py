"""Readers and writers: tablet CSV and JSON stores, zipped lemma corpora, flat records, dictionaries, reports."""

from __future__ import annotations

import datetime
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dubsar.operators.extract import with_defaults
from dubsar.sources import archives, splits

STORE = "map<string,struct<atf:string,rul:string,yr:string,mo:string,dy:string,des:string,conf:string>>"
GLOSSARY = "idx int, citation string, meaning string, pos string, category string, attestations long, forms array<struct<form:string,atf:string,count:long>>"
GROUND_TRUTH = "tablets array<struct<id:string,designation:string,source:string,note:string,expected:map<string,string>>>"
CORPUS_MEMBER, GLOSSARY_MEMBER = "corpusjson", "gloss-sux.json"
# Fixed value: one entry of the Markdown list of known issues.
ISSUE_ENTRY = """
## [{day}] {ref} — {what}
- **ATF**: `???`
- **Problem**: {what}
- **Status**: Open
- **Expected**: `???`
- **Ground truth entry added**: No
"""


def modified(spark: SparkSession, path: str) -> int | None:
    """When a file, or the youngest file of a written table, was last changed (ms); None where there is nothing. Any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    found = [x for x in store.listStatus(where) if x.isFile()] or [store.getFileStatus(where)]
    return max(x.getModificationTime() for x in found)


_CSV = {"quote": '"', "escape": '"', "multiLine": "true"}


def _columns(spark: SparkSession, path: str) -> list[str]:
    """The header of the first file."""
    return spark.read.csv(path, header=True, inferSchema=False, **_CSV).columns


def _records(spark: SparkSession, path: str) -> DataFrame:
    """r, the cells of a CSV as a struct of strings, and pos."""
    columns = _columns(spark, path)
    found = splits.records(spark, path, splits.Quoted()).where("NOT (start = 0 AND k = 0)")
    text = F.regexp_replace("text", "\r$", "")
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
    return found.where(text != "").select(F.from_csv(text, schema, _CSV).alias("r"), "pos")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV with a header; all columns strings. Cells may hold line ends; quotes stand around whole cells and are doubled inside.

    A file is read in as many tasks as it has splits.
    """
    return _records(spark, path).select("r.*")


def read_tablets(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Raw tablets with their defaults and pos, which rises with the place in the input: files by name, then rows.

    With a limit the first files are read in one task each, and only as far as it goes.
    """
    if not limit:
        rows = _records(spark, path)
        return with_defaults(rows.select(*(f"r.{c}" for c in rows.select("r.*").columns if c != "pos"), "pos"))
    rows, found = None, 0
    columns = _columns(spark, path)
    for ordinal, file in enumerate(sorted(spark.read.csv(path).inputFiles())):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        part = spark.read.schema(schema).csv(file, header=True, **_CSV).limit(limit - found)
        part = part.withColumn("pos", F.shiftleft(F.lit(ordinal).cast("long"), 32) + F.monotonically_increasing_id())
        rows = part if rows is None else rows.unionByName(part)
        found += part.count()
        if found >= limit:
            break
    return with_defaults(rows)


def with_text(tablets: DataFrame) -> DataFrame:
    """Tablets that have a text; of rows that repeat an id the last one stays."""
    held = tablets.where(F.btrim("transliteration", F.lit(" \t\r\n")) != "")
    last = held.groupBy("id_text").agg(F.max("pos").alias("pos"))
    return held.join(last, ["id_text", "pos"], "left_semi")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of tablets by id as rows of id_text, designation, transliteration, date_of_origin, confidence; of entries that repeat an id the last one stays.

    Entries are found in all splits of the file at once, also where it is a single line.
    """
    found = splits.records(spark, path, splits.Entries())
    entry = F.concat(F.lit("{"), F.regexp_replace("text", r"^[\s,{\x{FEFF}]+", ""), F.lit("}}"))
    rows = found.select("pos", F.explode(F.from_json(entry, T._parse_datatype_string(STORE))).alias("id_text", "t")).groupBy("id_text").agg(F.max_by("t", "pos").alias("t"))
    part = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit(""))
    return rows.select("id_text", part("des").alias("designation"), part("atf").alias("transliteration"), F.concat_ws(".", part("rul"), part("yr"), part("mo"), part("dy")).alias("date_of_origin"), part("conf").alias("confidence"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """tablet_id, source, field, want, as_list per expectation that is not null."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<" + GROUND_TRUTH.replace("tablets ", "tablets:") + ">").alias("g"))
    rows = text.select(F.explode("g.tablets").alias("t")).select(F.col("t.id").alias("tablet_id"), F.col("t.source").alias("source"), F.explode("t.expected").alias("field", "value")).where("value is not null")
    listed = F.from_json("value", "array<string>")
    as_list = F.startswith(F.col("value"), F.lit("["))
    return rows.select("tablet_id", "source", "field", F.when(as_list, listed).otherwise(F.array("value")).alias("want"), as_list.alias("as_list"))


def read_zip_members(spark: SparkSession, path: str, containing: str = CORPUS_MEMBER, group: int = archives.GROUP) -> DataFrame:
    """doc and json of the JSON members of zip archives whose name holds a string; a task reads a group of members by their ranges.

    In stores that Python does not reach, an archive is one row of Spark's binaryFile source, and 2 GB at most.
    """
    files = sorted(spark.read.format("binaryFile").load(path).inputFiles())
    if all(archives.reached(f) for f in files):
        spark.dataSource.register(archives.ZipMembers)
        return spark.read.format("zip_members").option("archives", "\n".join(files)).option("containing", containing).option("group", group).load()

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.endswith(".json") and containing in name:
                            yield pd.DataFrame({"doc": [name], "json": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "doc string, json string")


def read_glossary_entries(spark: SparkSession, path: str) -> DataFrame:
    """idx, cf, gw, pos, icount, forms of a zipped glossary; empty without that member."""
    whole = read_zip_members(spark, path, GLOSSARY_MEMBER)
    kind = "struct<entries:array<struct<cf:string,gw:string,pos:string,icount:string,forms:array<struct<n:string,icount:string>>>>>"
    return whole.select(F.posexplode(F.from_json("json", kind)["entries"]).alias("idx", "e")).select("idx", "e.*")


def write_flat(flat: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Flat records or pairs, overwriting; CSV with a header, or Parquet."""
    out = flat.write.mode("overwrite")
    out.csv(path, header=True, quote='"', escape='"') if fmt == "csv" else out.format(fmt).save(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_names(spark: SparkSession, path: str | None) -> DataFrame:
    """A dictionary that write_json wrote; an empty one without a path or where nothing lies there."""
    from dubsar.operators.names import NAMES

    known = path and modified(spark, path) is not None
    return spark.read.schema(NAMES).json(path) if known else spark.createDataFrame([], NAMES)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """A glossary that write_json wrote."""
    return spark.read.schema(GLOSSARY).json(path)


def serving_names(names: DataFrame) -> DataFrame:
    """Keys as the annotator spells them."""
    return names.withColumn("form", F.replace("form", F.lit("kuₓ"), F.lit("kux")))


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON string per row, for a service to send."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def dump_report(report: dict | list[dict], path: str) -> None:
    """A small finished report as one JSON file beside the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2)


def append_issue(path: str, what: str, tablet_id: str | None = None, day: datetime.date | None = None) -> None:
    """Add an open issue to a Markdown list beside the driver."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(ISSUE_ENTRY.format(day=day or datetime.date.today(), ref=f"P{tablet_id}" if tablet_id else "snippet", what=what))
