"""Chat formatting from reply trees.

Nodes name their parent. Iterative self-joins double the distance each node looks
up (parent, grandparent, ...), so a path of length n takes log2(n) joins and every
node learns its root, depth and summed score. Leaves are ranked per tree by the
score of their path; walking the same distances back enumerates the nodes of each
chosen path. Each path becomes one conversation. Built-in functions only; every
round is a table in shared storage.

Template, per turn: "### role: text </turn>\n". Inside roles and texts a backslash,
"#", "<" (and ":" in roles) become two-character codes, so no control string can
occur there; the codes are undone exactly. The loss mask holds the span of each
assistant text in code points.

Defined results: null roles and texts are empty; an empty table gives no
conversation; in conversations, rows of equal turn go by role, then text, and
repeated rows are turns of their own; null turns come first; a node whose parent is
unknown is a root; a null conv_id or tree is one of its own, like any other; nodes on a cycle belong to no path; equal path scores fall to
the smallest leaf; columns that are not named are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dubsar.llm.shared import stored

OPEN, MID, CLOSE = "### ", ": ", " </turn>\n"
CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
TRAINED_ROLE = "assistant"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, code in (*CODES, (":", "\\c")) if role else CODES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescaped(text: Column) -> Column:
    """Undo escaped; every backslash there opens a code, so the order of the first ones is free."""
    out = text
    for plain, code in ((":", "\\c"), *reversed(CODES)):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def as_tree(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as nodes: each replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long") - 1)
    return placed.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(nodes: DataFrame, branches: int = 1, most: int = 40) -> DataFrame:
    """tree, branch, depth, node of the nodes on the best root-to-leaf paths of nodes (tree, node, parent, score)."""
    ids = nodes.select("tree", "node")
    parents = nodes.select("tree", "node", "parent", "score").join(ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known")), ["tree", "parent"], "left")
    up = F.when(F.col("known"), F.col("parent"))
    # After k rounds: hop is the ancestor 2**k up, dist the edges and total the score between them.
    state = stored(parents.select("tree", "node", up.alias("hop"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("dist"), F.col("score").cast("double").alias("total")), "chat-hops")
    levels = [state.select("tree", "node", "hop")]
    edges = levels[0]
    for _ in range(most):
        if not state.where("hop is not null").limit(1).count():
            break
        far = state.select("tree", F.col("node").alias("hop"), F.col("hop").alias("hop2"), F.col("dist").alias("dist2"), F.col("total").alias("total2"))
        climbing = state.where("hop is not null").join(far, ["tree", "hop"])  # nodes that have met their root rest
        moved = climbing.select("tree", "node", F.col("hop2").alias("hop"), (F.col("dist") + F.col("dist2")).alias("dist"), (F.col("total") + F.col("total2")).alias("total"))
        state = stored(moved.unionByName(state.where("hop is null")), "chat-hops")
        levels.append(state.select("tree", "node", "hop"))
    inner = edges.where("hop is not null").select("tree", F.col("hop").alias("node")).distinct()
    leaves = state.where("hop is null").join(inner, ["tree", "node"], "left_anti")
    if branches == 1:
        top = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("total")).alias("worse"), "node", "dist")).alias("b"))
        chosen = top.select("tree", F.lit(1).alias("branch"), F.col("b.node").alias("node"), F.col("b.dist").alias("depth"))
    else:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
        chosen = leaves.withColumn("branch", rank).where(F.col("branch") <= branches).select("tree", "branch", "node", F.col("dist").alias("depth"))
    path = stored(chosen, "chat-paths")
    for k in range(len(levels) - 1, -1, -1):
        hops = levels[k].where("hop is not null")
        above = path.join(hops, ["tree", "node"]).select("tree", "branch", F.col("hop").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        path = path.unionByName(above)
        if k % 3 == 0:
            path = stored(path, "chat-paths")
    return path


def formatted(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, branch, formatted, loss_spans (start, end in code points) of every chosen path."""
    named = _formatted(nodes.where("tree is not null"), branches)
    nameless = nodes.where("tree is null")
    if not nameless.limit(1).count():
        return named
    # A null equals nothing in joins: its tree is worked out by itself, under another name.
    alone = _formatted(nameless.withColumn("tree", F.lit(0)), branches)
    return named.unionByName(alone.withColumn("conv_id", F.lit(None).cast(named.schema["conv_id"].dataType)))


def _formatted(nodes: DataFrame, branches: int) -> DataFrame:
    """The same where no tree is null."""
    path = best_paths(nodes, branches)
    turns = path.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = escaped(F.col("role"), role=True), escaped(F.col("text"))
    one = F.struct("depth", (F.coalesce("role", F.lit("")) == TRAINED_ROLE).alias("trained"), F.concat(F.lit(OPEN), role, F.lit(MID)).alias("head"), text.alias("text"))
    rows = turns.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(one)).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["text"], F.lit(CLOSE))), "")
    lengths = F.transform("t", lambda x: F.struct(x["trained"].alias("trained"), F.length(x["head"]).alias("h"), F.length(x["text"]).alias("n")))
    spans_type = "array<struct<start:long,end:long>>"
    walk = F.aggregate(
        lengths,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans_type).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["h"] + x["n"] + len(CLOSE)).alias("at"),
            F.when(x["trained"], F.concat(acc["out"], F.array(F.struct((acc["at"] + x["h"]).alias("start"), (acc["at"] + x["h"] + x["n"]).alias("end"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return rows.select(F.col("tree").alias("conv_id"), "branch", whole.alias("formatted"), walk.alias("loss_spans"))


def parsed(output: DataFrame) -> DataFrame:
    """Output of formatted read back: adds turns (role, text) and loss_text."""
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")
    turn = lambda p: F.struct(
        unescaped(F.substring(p, F.lit(len(OPEN) + 1), F.instr(p, F.lit(MID)) - (len(OPEN) + 1))).alias("role"),
        unescaped(F.substring(p, F.instr(p, F.lit(MID)) + len(MID), F.length(p))).alias("text"),
    )
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return output.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(masked, "")})
