"""A trie of conversation prefixes, named by prefix doubling.

Turns get dense integer names by their role and text; pairs of neighbouring blocks of
2^k turns get a name for the block of 2^(k+1), so that log2(length) rounds of joins
name every aligned block. The first d turns are then the blocks that the binary digits
of d call for (13 = 8 + 4 + 1), at most log2(d) + 1 names: equal lists of names, equal
prefixes. Grouping by depth and names gives the nodes.

Nothing below a node is ever gathered. Each node is owned by its smallest member. Along
a conversation members only leave, so what it owns is the tail of its path, and every
sum over a subtree is a sum over members of one number each: the words of turns from
that depth on that the conversation does not own are what storing the trie saves; a
conversation that owns a childless node is one leaf. Such sums are combined before they
are shuffled, however many conversations share a node. Rows that share a node or a
conversation meet a table of one row each, in joins whose large keys adaptive execution
splits. Positions and running sums inside a conversation go by pieces (ranges of rows,
blocks of PIECE turns), so a conversation may be of any length. Ids that end at a node
are packed by ranges of 2^CHUNK_BITS and hashed as a stream.

Defined results: rows without conv_id belong to no conversation and are left out; null
roles and texts are empty; null turns come first, rows of equal turn go by the digest of
role and text, and repeated rows are turns of their own; an empty table gives no nodes;
a text of any length is one digest; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dubsar.llm.shared import WORD, ranked, stored

#: Conversations of a family begin with the first turns of its first one; fewer than HEADS of them.
FAMILY, HEADS = 20, 4
#: Turns of a conversation that one window sums.
PIECE = 4096
#: Ids are packed into one row by ranges of 2^CHUNK_BITS.
CHUNK_BITS = 10


def placed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as conv_id, pos (from 0), say (digest of role and text), words; and conversations as conv_id, n (their turns)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    say = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", say.alias("say"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns, sizes = ranked(stored(rows, "trie-turns"), "conv_id", ["turn", "say"], "trie")
    return turns.select("conv_id", F.col("_rank").cast("long").alias("pos"), "say", "words"), sizes.select("conv_id", F.col("_size").cast("long").alias("n"))


def rebuilt(turns: DataFrame, sizes: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first h turns put in place of by those of its family's first, h by the CRC of its id; at most heads - 1 rows go to family - 1 others."""
    first = F.col("conv_id") - F.col("conv_id") % family
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    of_first = sizes.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.col("n").alias("there"))
    facts = sizes.select("conv_id", "n", first.alias("first"), h.alias("h")).join(of_first, "first", "left")
    facts = facts.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))).select("conv_id", "first", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    facts = stored(facts, "trie-rebuilt-sizes")
    lent = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "first")
    begun = facts.where("taken > 0").join(lent, "first").where("pos < taken").select("conv_id", "pos", "say", "words")
    rest = turns.where(F.col("pos") >= h).join(facts, "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "say", "words")
    return begun.unionByName(rest), facts.select("conv_id", "n")


def _named(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """rows with keys replaced by one dense number, b, for each different value of them."""
    kinds = rows.select(*keys).distinct().select(*keys, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place"))
    kinds = stored(kinds, f"trie-{tag}")
    counts = kinds.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each partition of a shuffle
    names = kinds.join(F.broadcast(counts), "_part").select(*keys, (F.col("_before") + F.col("_place")).alias("b"))
    return rows.join(names, keys).drop(*keys)


def _blocks(turns: DataFrame, longest: int) -> DataFrame:
    """conv_id, k, j, b: the name of turns j * 2^k to (j + 1) * 2^k - 1, for all k with such blocks."""
    level = stored(_named(turns.select("conv_id", F.col("pos").alias("j"), "say"), ["say"], "names0"), "trie-blocks0")
    found, k = level.withColumn("k", F.lit(0)), 0
    while 2 << k <= longest:
        side = lambda bit: F.max(F.when(F.col("j") % 2 == bit, F.col("b")))
        pairs = level.groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(side(0).alias("left"), side(1).alias("right")).where("right IS NOT NULL")
        k += 1
        level = stored(_named(pairs, ["left", "right"], f"names{k}"), f"trie-blocks{k}")
        found = found.unionByName(level.withColumn("k", F.lit(k)))
    return found.select("conv_id", "k", "j", "b")


def _with_prefixes(turns: DataFrame, blocks: DataFrame, longest: int) -> DataFrame:
    """turns with depth and node, the node of the prefix that ends with this turn."""
    depth = F.col("pos") + 1
    digits = F.expr(f"filter(sequence(0, {max(longest, 1).bit_length() - 1}), k -> shiftright(pos + 1, k) % 2 = 1)")
    asked = turns.select("conv_id", depth.alias("depth"), F.explode(digits).alias("k"))
    asked = asked.withColumn("j", F.expr("shiftright(depth, k) - 1"))
    parts = asked.join(blocks, ["conv_id", "k", "j"]).groupBy("conv_id", "depth").agg(F.sort_array(F.collect_list(F.struct("k", "b")), asc=False).alias("parts"))
    node = F.concat_ws(".", F.col("depth").cast("string"), F.transform("parts", lambda p: p["b"].cast("string")))
    return turns.withColumn("depth", depth).join(parts, ["conv_id", "depth"]).withColumn("node", node).drop("parts", "pos", "say")


def _running(turns: DataFrame) -> DataFrame:
    """turns with upto, the words of the conversation up to and with this turn."""
    piece = F.expr(f"pos div {PIECE}")
    rows = turns.withColumn("piece", piece)
    within = F.sum("words").over(Window.partitionBy("conv_id", "piece").orderBy("pos"))
    sums = rows.groupBy("conv_id", "piece").agg(F.sum("words").alias("said"))
    before = F.sum("said").over(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    later = sums.withColumn("before", before).where("piece > 0").select("conv_id", "piece", "before")
    return rows.withColumn("within", within).join(later, ["conv_id", "piece"], "left").withColumn("upto", F.col("within") + F.coalesce("before", F.lit(0))).drop("piece", "within", "before")


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node over its rows of packed ids, which come together and in order."""
    node, run = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if at != node:
                if run is not None:
                    done.append((node, run.hexdigest()))
                node, run = at, hashlib.sha256(ids.encode())
            else:
                run.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in done], pa.string()), "ends_sha256": pa.array([h for _, h in done], pa.string())})
    if run is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [run.hexdigest()]})


def _ends(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, conv_id): the digest of its ids, ascending, comma-joined."""
    packed = ends.groupBy("node", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    packed = packed.select("node", "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return packed.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(_stream_digests, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of all prefixes of conversations: turns as conv_id, pos, say, words; sizes with conv_id, n, turnless ones too.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    sizes = stored(sizes, "trie-sizes")
    told = sizes.agg(F.max("n").alias("longest"), F.min("conv_id").alias("least")).first()
    longest, least = told["longest"] or 0, F.lit(told["least"]).cast("long")
    turns = stored(turns.join(sizes, "conv_id"), "trie-rebuilt")
    blocks = _blocks(turns, longest)
    paths = stored(_with_prefixes(_running(turns), blocks, longest), "trie-paths")

    owners = paths.groupBy("node").agg(F.min("conv_id").alias("owner"), F.max("n").alias("deepest"))
    paths = paths.join(owners, "node")
    other = F.col("owner") != F.col("conv_id")
    leaf = ~other & (F.col("depth") == F.col("n")) & (F.col("deepest") == F.col("depth"))
    paths = stored(paths.select("conv_id", "depth", "node", "words", "upto", "n", F.when(other, F.col("owner")).alias("other"), leaf.alias("leaf")), "trie-owned")
    not_own = lambda c: F.max(F.when(F.col("other").isNotNull(), c))
    facts = paths.groupBy("conv_id").agg(not_own(F.struct("depth", "other")).alias("last"), not_own(F.col("upto")).alias("shared"), F.max(F.col("leaf").cast("long")).alias("leaf"))
    facts = facts.select("conv_id", F.coalesce("last.depth", F.lit(0)).alias("till"), F.coalesce("last.other", least).alias("above"), F.coalesce("shared", F.lit(0)).alias("shared"), "leaf")

    own_child = (F.col("depth") < F.col("n")) & (F.col("depth") >= F.col("till"))
    saved = F.when(F.col("depth") <= F.col("till"), F.col("shared") - F.col("upto") + F.col("words")).otherwise(0)
    parent = F.when(F.col("depth") > F.col("till"), F.when(F.col("depth") == F.col("till") + 1, F.col("above")).otherwise(F.col("conv_id")))
    each = paths.drop("leaf").join(facts, "conv_id").select("node", "depth", "conv_id", parent.alias("parent"), own_child.alias("child"), "leaf", saved.alias("saved"))
    root = sizes.join(facts, "conv_id", "left").select(
        F.lit("0").alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent"),
        ((F.col("n") > 0) & (F.col("till") == 0)).alias("child"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("shared", F.lit(0)).alias("saved"),
    )
    nodes = each.unionByName(root).groupBy("node", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("child").cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    ending = paths.where("depth = n").select("node", "conv_id").unionByName(sizes.where("n = 0").select(F.lit("0").alias("node"), "conv_id"))
    nodes = nodes.join(_ends(ending), "node", "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.when(F.col("depth") == 0, 1).otherwise(0)).cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long"), F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
    )
