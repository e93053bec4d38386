"""Deduplicated WARC archives: one response per payload, revisits for the rest.

Only headers travel: (digest, id) pairs are pre-aggregated and shuffled by payload
digest to find the smallest id of each payload; payloads stay where they were read.
Every page then becomes one record under fresh headers. The archive is written by
Spark's text sink with the record separator as its line end, so its commit protocol
makes each file appear once and whole, and gzip-compressed; files hold a bounded
number of records. The reader parses records by Content-Length, computes digests
of response payloads anew, and joins revisits to the responses they name.

Defined results: a null payload is empty; an empty table gives an archive without
records; rows that repeat a page id stay separate records; of equal payloads the
smallest id is the response (rows that repeat that id with that payload are all
responses); null urls give an empty target; line ends in a url become spaces;
columns other than id, url and payload are not read. A null page id is written as
such and read back as null.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dubsar.llm.shared import fresh_path

VERSION = "WARC/1.1"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Payloads up to so many bytes go into files of so many records at most, so that a file stays near 64 MB; still larger ones have a file each.
FILES = ((1 << 16, 1000), (1 << 20, 64), (None, 1))
READ = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1, from its hex form, twenty bits at a time."""
    digest = F.sha1(payload)
    parts = (F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8))
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, DataFrame, Column]:
    """Pages with digest and size; the digests that occur twice or more with their smallest id; whether a page revisits it."""
    whole = pages.select("page_id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    sized = whole.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload").cast("long")})
    heads = sized.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
    shared = heads.where("copies > 1").select("digest", "original")
    other = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return sized, shared, other


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per row of pages (page_id, url, payload)."""
    sized, shared, other = resolve(pages, min_bytes)
    n = shared.count()
    small = F.broadcast(shared) if n <= 500_000 else shared
    placed = sized.join(small, "digest", "left").withColumn("original", F.when(other & (F.col("size") >= min_bytes), F.col("original")))
    revisit = F.col("original").isNotNull()
    body = F.when(revisit, "").otherwise(F.col("payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\r\n"))
    record = F.concat(
        line(VERSION),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: ", name(F.col("page_id"))),
        line("WARC-Target-URI: ", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")),
        line("WARC-Date: ", DATE),
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To: ", name(F.col("original"))), line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type: text/html; charset=utf-8"),
        line("Content-Length: ", F.when(revisit, 0).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
        body,
    )
    longest = pages.agg(F.max(F.octet_length("payload")).alias("n")).first()["n"] or 0
    above = -1
    for most, records in FILES:
        part = placed.where((F.col("size") > above) & (F.lit(True) if most is None else F.col("size") <= most))
        part.select(record.alias("value")).write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
        if most is None or longest <= most:
            break
        above = most


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of each record of an uncompressed archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:head].decode().split("\r\n")
        if first != VERSION:
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        start = head + 4
        end = start + int(fields["Content-Length"])
        if data[end : end + 4] != END.encode():
            raise ValueError(f"record at {at} does not end where it should")
        yield fields, view[start:end]
        at = end + 4


def _page(name: str | None) -> int | None:
    return None if not name or name == "<urn:page:none>" else int(name[len("<urn:page:") : -1])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            rows: list[tuple] = []
            for h, block in parse(zlib.decompress(memoryview(content.as_buffer()), 31)):
                if h["WARC-Type"] == "response":
                    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()  # noqa: S324
                    rows.append((_page(h["WARC-Record-ID"]), "response", None, len(block), digest, h["WARC-Target-URI"]))
                else:
                    rows.append((_page(h["WARC-Record-ID"]), "revisit", _page(h["WARC-Refers-To"]), None, h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Target-URI"]))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; a revisit gets the size of the response it names, joined by id and digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    records = files.mapInArrow(_read, READ)
    return records


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with payload_bytes filled in for revisits. Responses pass by untouched; only headers are joined."""
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes")
    wanted = revisits.select("refers_to", "payload_digest").distinct()
    originals = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    sizes = originals.join(wanted, ["refers_to", "payload_digest"], "left_semi").groupBy("refers_to", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    filled = revisits.join(sizes, ["refers_to", "payload_digest"], "left")
    return records.where("record_type = 'response'").unionByName(filled)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, payload) as archives in the shared folder and read them back."""
    from dubsar.llm.shared import stored

    spark = pages.sparkSession
    write_archive(pages, path := fresh_path(spark, "warc"), min_bytes)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, "1")  # here a row is a whole file
    try:
        headers = stored(read_archive(spark, path), "warc-headers")
    finally:
        spark.conf.set(key, before)
    return resolve_revisits(headers)
