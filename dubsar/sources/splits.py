"""Records that hold line ends, or that no line end parts at all, read from all splits of a file at once.

Spark's text source cuts a file at a separator byte, in parallel and from any store. Whether a
separator ends a record depends on what came before (an open quote, open braces), so three steps follow:

1. each split says how it changes that state, for either state of the quotes it may begin in;
2. running sums over the few rows of this table give the state in which each split begins;
3. each split joins its pieces into records. What a split cannot finish, or finds begun, is a fragment;
   fragments are two a split at most, and only they are shuffled and put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dubsar.sources.scratch import stored

_ESCAPED = re.compile(r"\\.", re.DOTALL)
#: Records that one Arrow batch holds at most, and characters beyond which it is sent.
ROWS, CHARS = 2_000, 1 << 22


class Quoted:
    """Lines of a file whose cells may stand in quotes, quotes inside them doubled: a line ends a record where no quote is open."""

    sep, tail_counts = "\n", True

    def step(self, piece: str, quoted: int) -> tuple[int, int]:
        """The quotes after a piece, and how much deeper it leads."""
        return quoted ^ (piece.count('"') & 1), 0

    def ends(self, quoted: int, depth: int) -> bool:
        return not quoted

    def begins(self, quoted: int, depth: int) -> bool:
        """Whether no record is open in this state."""
        return not quoted


class Entries:
    """Entries of one JSON object whose values are objects: a brace outside strings ends one where it leads back to the top."""

    sep, tail_counts = "}", False

    def step(self, piece: str, quoted: int) -> tuple[int, int]:
        # No escape reaches beyond a piece: none ends with a brace.
        parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
        after = quoted ^ ((len(parts) - 1) & 1)
        return after, sum(p.count("{") for p in parts[quoted::2]) - (not after)

    def ends(self, quoted: int, depth: int) -> bool:
        return not quoted and depth == 1

    def begins(self, quoted: int, depth: int) -> bool:
        return not quoted and depth <= 1


def _pieces(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    text = spark.read.option("lineSep", sep).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _states(pieces: DataFrame, kind: Quoted | Entries) -> DataFrame:
    """file, start, ordinal (of the split in the order of files and places), quoted, depth: the state that a split begins in."""

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple = ()
        quoted, deeper = [0, 1], [0, 0]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, quoted[0], *deeper), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["file", "start", "flips", "deeper0", "deeper1"])

        for b in batches:
            for file, start, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, start) != at:
                    if at:
                        yield told()
                    at, quoted, deeper = (file, start), [0, 1], [0, 0]
                for p in (0, 1):
                    quoted[p], by = kind.step(piece, quoted[p])
                    deeper[p] += by
        if at:
            yield told()

    each = pieces.mapInArrow(changes, "file string, start long, flips int, deeper0 long, deeper1 long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2
    each = each.withColumn("quoted", quoted.cast("int")).withColumn("deeper", F.when(F.col("quoted") == 1, F.col("deeper1")).otherwise(F.col("deeper0")))
    ordinal = F.row_number().over(Window.orderBy("file", "start")) - 1  # a row for each split of the input
    return each.select("file", "start", ordinal.cast("long").alias("ordinal"), "quoted", F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("depth"))


def _joined(pieces: DataFrame, states: DataFrame, kind: Quoted | Entries, fragments: bool) -> DataFrame:
    """file, start, ordinal, k, part, text: records of each split (part whole), or what it begins (tail), ends (head) or only goes through (through)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        at: tuple = ()
        held: list[str] = []
        found = quoted = depth = k = 0
        opened = False

        def sent() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["file", "start", "ordinal", "k", "part", "text"])

        def add(part: str) -> None:
            nonlocal chars
            if (part != "whole") == fragments:
                out.append((*at, k, part, kind.sep.join(held)))
                chars += len(out[-1][-1])

        for b in batches:
            for file, start, piece, ordinal, q, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, start, ordinal) != at:
                    if held:
                        add("through" if opened and not found else "tail")
                    at, held, found, k, quoted, depth = (file, start, ordinal), [], 0, 0, q, d
                    opened = not kind.begins(q, d)
                held.append(piece)
                quoted, by = kind.step(piece, quoted)
                depth += by
                if kind.ends(quoted, depth):
                    head = opened and not found
                    add("head" if head else "whole")
                    held, found, k = [], 1, k + (not head)
                    if len(out) >= ROWS or chars >= CHARS:
                        yield sent()
                        out, chars = [], 0
        if held:
            add("through" if opened and not found else "tail")
        if out:
            yield sent()

    known = pieces.join(F.broadcast(states), ["file", "start"]).select("file", "start", "value", "ordinal", "quoted", "depth")
    return known.mapInArrow(run, "file string, start long, ordinal long, k long, part string, text string")


def records(spark: SparkSession, path: str | list[str], kind: Quoted | Entries) -> DataFrame:
    """file, start, k, pos, text of every record of the files: pos rises with the names of files and the place in them.

    The state table has a row for each split, and is broadcast; fragments are stored. Records are read when asked for. A last
    record that nothing ends counts among Quoted ones and not among Entries.
    """
    pieces = _pieces(spark, path, kind.sep)
    states = stored(_states(pieces, kind), "splits")
    pos = F.shiftleft("ordinal", 32) + F.col("k")
    whole = _joined(pieces, states, kind, False).select("file", "start", "k", pos.alias("pos"), "text")
    loose = stored(_joined(pieces, states, kind, True), "fragments")
    # What a split begins is its last; what it ends or goes through comes first and belongs to the last one begun before.
    late = (F.col("part") == "tail").cast("int")
    along = Window.partitionBy("file").orderBy("start", "late").rowsBetween(Window.unboundedPreceding, 0)
    owners = loose.select("file", "start", late.alias("late")).withColumn("owner", F.max(F.when(F.col("late") == 1, F.col("start"))).over(along))
    grouped = loose.withColumn("late", late).join(owners, ["file", "start", "late"]).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("start", "late", "text"))).alias("parts"), F.max(F.when(F.col("late") == 1, F.struct("k", "ordinal"))).alias("of"), F.max((F.col("part") == "head").cast("int")).alias("ended")
    )
    if not kind.tail_counts:
        grouped = grouped.where("ended = 1")
    text = F.array_join(F.transform("parts", lambda p: p["text"]), kind.sep)
    put = grouped.select("file", F.col("owner").alias("start"), "of.k", (F.shiftleft("of.ordinal", 32) + F.col("of.k")).alias("pos"), text.alias("text"))
    return whole.unionByName(put)
