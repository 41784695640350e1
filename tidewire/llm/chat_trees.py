"""Chat formatting from reply trees.

A message has a parent or is a root; every leaf ends one conversation. Self-joins give each message
its ancestor 1, 2, 4, ... steps up, and the same table, read from the longest step down, lists all
ancestors of each leaf: a number of joins logarithmic in the depth, and one row per message of a
path. Branches are ranked by score, and each chosen path becomes one text with a loss mask.

Template: a turn is ``### role: text</turn>`` and a line feed. In roles and texts the characters
``\\``, ``#`` and ``<`` are written ``\\b``, ``\\h`` and ``\\l``, and ``:`` in roles ``\\c``, so that no mark
of the template can occur inside them and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.session import materialise

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
# What is written for each character (fixed by the template); the backslash comes first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
LOSS_ROLE = "assistant"


def escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, written in escapes:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, escapes=ROLE_ESCAPES) -> Column:
    # Every backslash written begins one escape, so the order only matters for the backslash itself.
    for plain, written in reversed(escapes):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def turn_nodes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages (tree, tree_id, node, parent, role, text, score) of plain conversations.

    A conversation's rows by turn, then role and text, form one chain; repeated rows are turns of
    their own, a NULL turn comes first. NULL role or text counts as empty, NULL conversation is a
    conversation. Every message scores 1.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit(""))
    rows = turns.select(key.alias("tree"), F.col(conv_col).alias("tree_id"), F.col(turn_col).alias("at"), role.alias("role"), text.alias("text"))
    place = F.row_number().over(W.partitionBy("tree").orderBy("at", "role", "text")).cast("long")
    rows = rows.withColumn("node", place)
    return rows.select("tree", "tree_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def ancestor_rows(links: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist) for every message on the path from a root to each leaf.

    ``links`` has tree, node, parent (long or NULL) without repeats of (tree, node). A parent that
    is not there makes its child a root. Messages whose chain of parents runs in a circle have no
    root, and leaves that hang on one are left out.
    """
    there = links.select("tree", F.col("node").alias("up"))
    first = links.select("tree", "node", F.col("parent").alias("up")).where("up is not null").join(there, ["tree", "up"], "left_semi")
    jumps = [materialise(first.select("tree", "node", "up"), "jump-0")]
    largest = links.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    circles = None
    while not jumps[-1].isEmpty():
        if 1 << (len(jumps) - 1) >= largest:
            # More steps than messages: what still goes up goes round.
            circles = jumps.pop().select("tree", F.col("node").alias("leaf"))
            break
        step = jumps[-1]
        further = step.select("tree", F.col("node").alias("up"), F.col("up").alias("far"))
        jumps.append(materialise(step.join(further, ["tree", "up"]).select("tree", "node", F.col("far").alias("up")), f"jump-{len(jumps)}"))
    parents = first.select("tree", F.col("up").alias("node")).distinct()
    leaves = links.select("tree", "node").join(parents, ["tree", "node"], "left_anti").withColumnRenamed("node", "leaf")
    if circles is not None:
        leaves = leaves.join(circles, ["tree", "leaf"], "left_anti")
    rows = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("dist"))
    for k in reversed(range(len(jumps))):
        both = rows.join(jumps[k], ["tree", "node"], "left")
        each = F.array(F.struct("node", "dist"), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))))
        rows = both.select("tree", "leaf", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("at")).select("tree", "leaf", "at.node", "at.dist")
    return rows


def formatted_paths(nodes: DataFrame, branches: int | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(tree, tree_id, leaf, rank, score, formatted, mask): one row per chosen path.

    ``nodes`` as ``turn_nodes`` gives them. Paths of a tree are ranked by the sum of their
    messages' scores, ties by leaf; ``branches`` is how many to keep per tree (default: all).
    ``mask`` lists (start, length) of the texts of ``loss_role`` in ``formatted``, in code points.
    An empty table gives an empty result.
    """
    nodes = materialise(nodes, "chat-nodes")
    paths = ancestor_rows(nodes.select("tree", "node", "parent")).join(nodes, ["tree", "node"])
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(BETWEEN))
    paths = paths.select("tree", "tree_id", "leaf", "dist", "score", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    paths = paths.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = W.partitionBy("tree", "leaf").orderBy(F.desc("dist")).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    paths = paths.withColumn("start", start)
    loss = F.when(F.col("role") == loss_role, F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    turns = F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("order"), "piece")))
    whole = paths.groupBy("tree", "leaf").agg(
        F.first("tree_id").alias("tree_id"),
        F.sum("score").alias("score"),
        F.array_join(F.transform(turns, lambda t: t["piece"]), "").alias("formatted"),
        F.sort_array(F.collect_list(loss)).alias("mask"),
    )
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    whole = whole.withColumn("rank", rank)
    return whole if branches is None else whole.where(F.col("rank") <= branches)


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) parsed from ``formatted``, and ``loss_text`` cut out by ``mask``."""
    pieces = F.split("formatted", CLOSE)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    opened = F.transform(pieces, lambda p: F.substring(p, len(OPEN) + 1, 1 << 30))

    def parsed(p: Column) -> Column:
        role = F.substring_index(p, BETWEEN, 1)
        return F.struct(
            unescape(role).alias("role"), unescape(F.substr(p, F.length(role) + 1 + len(BETWEEN))).alias("text")
        )

    cut = F.transform("mask", lambda m: F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))
    return formatted.withColumn("turns", F.transform(opened, parsed)).withColumn(
        "loss_text", F.array_join(F.transform(cut, lambda c: unescape(c)), "")
    )
