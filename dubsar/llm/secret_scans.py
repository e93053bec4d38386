"""Secret scans over an incremental ledger of blobs.

A blob is a text named by its SHA-256. The ledger, a Parquet table in shared
storage, holds the findings of every (blob, rule version) scanned so far. A call
hashes all versions, scans one row of each blob that the ledger lacks, appends,
and joins findings back to every path. Built-in functions only.

Defined results: null text is the empty blob; empty table, empty result; repeated
rows share a blob and each gets its findings; ties between spans at one start go
by kind as listed; a null path keeps its row; other columns do not clash, since
only path and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dubsar.llm.shared import free_name, fresh_path, stored

# The base kinds and their patterns.
ASSIGN = r"""(?=[PpSsTtAa])([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Kinds that this method adds.
GITHUB = r"gh[pousr]_[A-Za-z0-9]{36,}"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
PEM = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
#: What goes with a header that PEM finds: all up to the matching end line; where that is missing, header fields and the runs of base64 that follow.
_BREAK = r"(?:\s|\\[nr])"
_BASE64 = rf"(?:[A-Za-z0-9+/]{{16,}}+={{0,2}}|[A-Za-z0-9+/]++={{1,2}}|[A-Za-z0-9+/]++={{0,2}}(?={_BREAK}*+(?:-----|\z)|[\x20\t]*+(?:[\r\n]|\\[nr])))"
PEM_WHOLE = rf"-----BEGIN ([A-Z ]{{0,30}})PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*+-----END \1PRIVATE KEY-----|(?:{_BREAK}*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_BREAK}*+{_BASE64})*+)"

BASE_KINDS = ("assign", "access", "hex")
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "github": GITHUB, "jwt": JWT, "pem": PEM}
RULE_VERSION = 1
MARK, STAND_IN = "\x01", "\x02"
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Ids broadcast at most; beyond it the scan set is found by a shuffled join.
MOST_BROADCAST = 2_000_000


def _marked(text: Column, pattern: str) -> Column:
    """text cut at its matches: every second piece is one. The mark is no part of any pattern."""
    return F.split(F.regexp_replace(text, pattern, MARK + "$0" + MARK), MARK)


def _spans(text: Column, kind: str) -> Column:
    """Spans of one kind in code points, in order; leftmost, non-overlapping."""
    rank = list(KINDS).index(kind)
    good = (lambda s: F.length(F.regexp_extract(s, ASSIGN, 2)) >= 6) if kind == "assign" else (lambda s: F.lit(True))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        span = F.struct(acc["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        out = F.when(acc["hit"] & good(piece), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(_marked(text, KINDS[kind]), start, step, lambda acc: acc["out"])


def find_spans(text: Column) -> Column:
    """All findings of a text, by start, then kind as listed."""
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(STAND_IN))
    none = F.array().cast(SPANS)
    each = (F.when(F.regexp_like(clean, F.lit(KINDS[k])), _spans(clean, k)).otherwise(none) for k in KINDS)
    return F.sort_array(F.concat(*each))


def redact(text: Column) -> Column:
    """The text with every finding's value replaced by a tag naming its kind; of a private key, of which the header is the finding, body and end line too."""
    # The mark, where a text has it, becomes a code of characters that no pattern knows, and itself again at the end.
    out = F.replace(F.replace(text, F.lit(STAND_IN), F.lit(STAND_IN + "\x03")), F.lit(MARK), F.lit(STAND_IN + "\x04"))
    # Keys go first and whole: the other kinds would break up their header and body.
    out = F.regexp_replace(out, PEM_WHOLE, "[REDACTED-PEM]")
    for kind, pattern in KINDS.items():
        tag = f"[REDACTED-{kind.upper()}]"
        if kind == "assign":

            def hide(piece: Column, tag: str = tag) -> Column:
                secret = F.length(F.regexp_extract(piece, ASSIGN, 2))
                return F.when(secret >= 6, F.concat(F.left(piece, F.length(piece) - secret), F.lit(tag))).otherwise(piece)

            pieces = F.transform(_marked(out, pattern), lambda s, i: F.when(i % 2 == 1, hide(s)).otherwise(s))
            out = F.when(F.regexp_like(out, F.lit(pattern)), F.array_join(pieces, "")).otherwise(out)
        else:
            out = F.regexp_replace(out, pattern, tag)
    return F.replace(F.replace(out, F.lit(STAND_IN + "\x04"), F.lit(MARK)), F.lit(STAND_IN + "\x03"), F.lit(STAND_IN))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger_path: str | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """Per row of versions: path, blob, findings. Only unseen (blob, rule version) pairs are scanned.

    ledger_path: the ledger to extend; None starts one in the shared folder.
    """
    spark = versions.sparkSession
    ledger_path = ledger_path or fresh_path(spark, "blob-ledger")
    body = F.coalesce(F.col(text), F.lit(""))
    blob = F.unhex(F.sha2(body, 256))
    paths = stored(versions.select(F.col(path), blob.alias("blob")), "blob-paths")
    schema = f"blob binary, rule_version int, findings {SPANS}"
    wanted = paths.groupBy("blob").agg(F.min(path).alias("rep"))
    if _exists(spark, ledger_path):
        seen = spark.read.schema(schema).parquet(ledger_path).where(F.col("rule_version") == rule_version)
        wanted = wanted.join(seen.select("blob"), "blob", "left_anti")
    wanted = stored(wanted, "blob-wanted")
    n_wanted, n_paths = wanted.count(), paths.count()
    texts = versions.select(F.col(path).alias("_path"), body.alias("_text"))
    reps = wanted.select(F.col("rep").alias("_path"))
    if n_paths - n_wanted <= min(n_wanted, MOST_BROADCAST):
        again = paths.select(F.col(path).alias("_path")).where(F.col("_path").isNotNull()).distinct().join(reps, "_path", "left_anti")
        todo = texts.join(F.broadcast(again), "_path", "left_anti")
    elif not n_wanted:
        todo = texts.limit(0)
    else:
        by = F.broadcast(reps) if n_wanted <= MOST_BROADCAST else reps.hint("shuffle_hash")
        todo = texts.join(by, texts["_path"].eqNullSafe(by["_path"]), "left_semi")
    found = todo.select(F.unhex(F.sha2("_text", 256)).alias("blob"), find_spans(F.col("_text")).alias("findings"))
    if n_wanted:
        one = found.groupBy("blob").agg(F.max("findings").alias("findings"))
        one.select("blob", F.lit(rule_version).cast("int").alias("rule_version"), "findings").write.mode("append").parquet(ledger_path)
    elif not _exists(spark, ledger_path):
        spark.createDataFrame([], schema).write.mode("append").parquet(ledger_path)
    led = spark.read.schema(schema).parquet(ledger_path).where(F.col("rule_version") == rule_version)
    hits = led.where(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"])  # two calls at once may both have scanned a blob
    return paths.join(hits, "blob", "left").select(path, F.hex("blob").alias("blob"), F.coalesce("findings", F.array().cast(SPANS)).alias("findings"))


def listed(findings: Column, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """kind:start:end of the findings of some kinds, comma-joined."""
    own = F.filter(findings, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda s: s["kind"] == kind)).cast("long")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with every finding of the ledger replaced by a tag; n_chars follows where it is a column.

    Only rows with findings are rewritten; the ids of those rows are broadcast when
    they are few enough, else joined by a shuffle. Null ids and texts, repeated rows and
    empty tables pass; columns of any name stay as they are.
    """
    mark, key = free_name(docs.columns, "_hit"), free_name(docs.columns, "_id")
    hit = stored(scan(docs).where(F.size("findings") > 0).select(F.col("doc_id").alias(key)).distinct().withColumn(mark, F.lit(True)), "secret-hits")
    side = F.broadcast(hit) if hit.count() <= MOST_BROADCAST else hit
    marked = docs.join(side, F.col("doc_id").eqNullSafe(F.col(key)), "left")
    new = {"text": F.when(F.col(mark), redact(F.col("text"))).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(mark), F.length(redact(F.col("text"))).cast("long")).otherwise(F.col("n_chars"))
    return marked.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
