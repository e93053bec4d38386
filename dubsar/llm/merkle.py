"""A Merkle manifest of a dataset: one tree for each source, and a tree of their roots.

A document's leaf is the hash of its fields, each written as "-" where null and else as
UTF-8 bytes, ":", value. Documents are placed by id within their source by a range
sort, so a source that holds a third of all rows is spread like any other. Each level
is a window by source and parent index whose ordered full frame collects the FAN
children of a run: they are the parent's preimage and one another's siblings. One row
of each run goes on as the parent, so a level has a sixteenth of the rows of the one
below. Proofs are handed down from the top by joins on source and parent index, one
row a run, and reach the single documents last. Built-in functions only.

Defined results: null fields are "-", so they differ from empty ones; a null source is
a source of its own, before all others; null ids come first in their source; equal ids
go by leaf, and repeated rows are leaves of their own; a text of any length is one
field; an empty table gives no rows; columns that are not named are dropped, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dubsar.llm.shared import ranked, stored

#: Children of a node.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """One field of a preimage: "-" for null, else byte count, ":", value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """The hash of a row of FIELDS, with some of them replaced."""
    return digest(F.concat(*(field(instead.get(c, F.col(c))) for c in FIELDS)))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings lead to."""
    return F.aggregate(path, start, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def proof(path: Column) -> Column:
    """All siblings on a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _levels(nodes: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level, and what remains of each group with the level where it does.

    nodes: g (group), i (index), n (nodes of the group), h (hash), p (payload). A run: g, i (parent's index), n
    (nodes of the parent's level), h (parent's hash), kids (h and p of its nodes in order).
    """
    levels: list[DataFrame] = []
    ends = nodes.where("n = 1").select("g", "h", "p", F.lit(0).alias("level"))
    while most > 1:
        within = "PARTITION BY g, i div {0}".format(FAN)
        kids = F.expr(f"collect_list(struct(h, p)) OVER ({within} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
        runs = nodes.where("n > 1").select("g", "i", "n", kids.alias("kids")).where(F.col("i") % FAN == 0)
        parent = digest(F.array_join(F.transform("kids", lambda k: k["h"]), ""))
        runs = stored(runs.select("g", F.expr(f"i div {FAN}").alias("i"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), parent.alias("h"), "kids"), f"{name}-level{len(levels)}")
        levels.append(runs)
        nodes = runs.select("g", "i", "n", "h", F.lit(None).cast(nodes.schema["p"].dataType).alias("p"))
        ends = ends.unionByName(nodes.where("n = 1").select("g", "h", "p", F.lit(len(levels)).alias("level")))
        most = -(-most // FAN)
    return levels, ends


def _paths(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """h, p, path and facts of the nodes that the levels began with; ends: g, level, h, p, path, facts of what remained."""
    at = lambda level: ends.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("i"), "h", "p", "path", "facts")
    known = at(len(levels))
    for level in reversed(range(len(levels))):
        hashes = F.transform("kids", lambda k: k["h"])
        upto = lambda a, k: F.array_join(F.slice(hashes, a, k), "")
        below = levels[level].select("g", "i", "kids").join(known.select("g", "i", "path", "facts"), ["g", "i"])
        # Each child's own step is cut from the run's hashes where the child is made, the steps above are shared.
        steps = F.transform("kids", lambda k, j: F.struct(k["h"].alias("h"), k["p"].alias("p"), j.cast("long").alias("j"), upto(F.lit(1), j).alias("left"), upto(j + 2, F.greatest(F.size("kids") - j - 1, F.lit(0))).alias("right")))
        below = below.select("g", "i", "path", "facts", F.explode(steps).alias("k"))
        path = F.concat(F.array(F.struct("k.left", "k.right")), F.col("path"))
        below = below.select("g", (F.col("i") * FAN + F.col("k.j")).alias("i"), "k.h", "k.p", path.alias("path"), "facts")
        known = below.unionByName(at(level))
    return known.select("h", "p", "path", "facts")


def manifest(docs: DataFrame, **beside: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, path of every row of docs, and the columns of beside, worked out from FIELDS."""
    rows = docs.select(*FIELDS)
    own = rows.select(F.struct("doc_id", *(c.alias(n) for n, c in beside.items())).alias("p"), leaf().alias("h"), field(F.col("source")).alias("g"), "source", "doc_id")
    leaves, sizes = ranked(stored(own, "merkle-leaves"), "g", ["doc_id", "h"], "merkle")
    most = sizes.agg(F.max("_size")).first()[0] or 0
    named = F.struct("p.*", "source")
    leaves = leaves.select("g", F.col("_rank").alias("i"), F.col("_size").alias("n"), "h", named.alias("p"))
    levels, ends = _levels(leaves, most, "merkle")
    ends = stored(ends, "merkle-subroots")

    named_sources = leaves.where("i = 0").select("g", F.col("p.source").alias("source"))
    tops = stored(ends.select("g", "h").join(named_sources, "g").select(F.lit("").alias("all"), "source", F.struct("g").alias("p"), "h"), "merkle-sources")
    sources, count = ranked(tops, "all", ["source"], "merkle-top")
    most = count.agg(F.max("_size")).first()[0] or 0
    top_levels, top_ends = _levels(sources.select(F.col("all").alias("g"), F.col("_rank").alias("i"), F.col("_size").alias("n"), "h", "p"), most, "merkle-top")
    top_ends = top_ends.select("g", "level", "h", "p", F.array().cast(STEP).alias("path"), F.struct(F.col("h").alias("root")).alias("facts"))
    top = stored(_paths(top_levels, top_ends).select("p.g", "path", F.struct(F.col("h").alias("subroot"), F.col("facts.root").alias("root")).alias("facts")), "merkle-roots")

    found = _paths(levels, ends.join(top, "g"))
    return found.select("p.doc_id", F.col("h").alias("leaf"), "facts.subroot", "facts.root", "path", *(F.col(f"p.{n}").alias(n) for n in beside))
