"""Chat formatting of reply trees.

Every message knows the one it replies to. Paths from a root to a leaf are listed by
self-joins of the parent table that double their reach each time, so their number is
the logarithm of the deepest path; each longer hop and what it adds to the paths are
written as tables. Branches are ranked by score, and each chosen path becomes one
conversation in a template whose control strings are escaped in texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinarm.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that this or other templates use as marks.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column, line: bool = False) -> Column:
    """The text with a backslash inside each control string, and before each backslash.

    ``line`` also puts one before line ends, for names that end at a line end.
    """
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in sorted(CONTROL, key=len, reverse=True):
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return F.replace(text, F.lit("\n"), F.lit("\\\n")) if line else text


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _key(column: Column) -> Column:
    """A join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def chain(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: each row replies to the one before it.

    Rows of a conversation are ordered by turn (null first), role and text; rows with
    the same turn are separate messages, also if they are alike.
    """
    order = Window.partitionBy(conversation).orderBy(turn, "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(
        F.col(conversation).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def paths(nodes: DataFrame) -> DataFrame:
    """Every root-to-leaf path: (tree, leaf, distance from the leaf, node) with the key columns ``_t``.

    A node whose parent is missing is a root. Nodes that lead to a cycle have no path. The
    rounds follow the deepest path: each hop and each round's new rows are written, so
    the plan of a round reads files and does not grow with the ones before.
    """
    base = written(nodes.select(_key(F.col("tree")).alias("_t"), "node", "parent"), "reply-nodes")
    up = written(base.select("_t", "node", F.col("parent").alias("above")).join(
        base.select("_t", F.col("node").alias("above")).hint("merge"), ["_t", "above"], "left_semi").select("_t", "node", "above"), "reply-hops")
    hops, reach, endless = [], 1, None
    largest = base.groupBy("_t").count().agg(F.max("count")).first()[0] or 1
    while not up.isEmpty():
        if reach >= largest:
            endless = up  # more steps than the tree has nodes: these lead to a cycle
            break
        hops.append(up)
        far = up.select("_t", F.col("node").alias("middle"), F.col("above").alias("far")).hint("merge")
        up = written(up.withColumnRenamed("above", "middle").join(far, ["_t", "middle"]).select("_t", "node", F.col("far").alias("above")), "reply-hops")
        reach *= 2
    inner = (hops[0] if hops else up).select("_t", F.col("above").alias("node")).distinct()
    leaves = base.join(inner.hint("merge"), ["_t", "node"], "left_anti")
    if endless is not None:
        leaves = leaves.join(endless.select("_t", "node").hint("merge"), ["_t", "node"], "left_anti")
    found = written(leaves.select("_t", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance")), "reply-paths")
    for k, hop in enumerate(hops):
        further = found.join(hop.hint("merge"), ["_t", "node"]).select("_t", "leaf", F.col("above").alias("node"), (F.col("distance") + (1 << k)).alias("distance"))
        found = found.unionByName(written(further, "reply-paths"))
    return found


def format_trees(nodes: DataFrame, branches: int = 1, trained: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, rank, formatted, loss_spans.

    ``nodes`` has tree, node (unique in its tree), parent, role, text and score. Paths
    of a tree are ranked by the sum of their scores (null counts 0), ties by the lower
    leaf; the best ``branches`` are kept. A null text or role is empty. ``loss_spans``
    are the character ranges of the texts of the ``trained`` role.
    """
    listed = paths(nodes)
    told = nodes.select(
        _key(F.col("tree")).alias("_t"), "node", F.col("tree"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    full = listed.join(told, ["_t", "node"])
    if branches is not None:
        ranked = full.groupBy("_t", "leaf").agg(F.sum("score").alias("total")).withColumn(
            "rank", F.row_number().over(Window.partitionBy("_t").orderBy(F.desc("total"), "leaf")))
        full = full.join(ranked.where(F.col("rank") <= branches).drop("total"), ["_t", "leaf"])
    head = F.concat(F.lit(START), escape(F.col("role"), line=True), F.lit("\n"))
    body = escape(F.col("text"))
    pieces = full.select(
        "_t", "tree", "leaf", "rank", "role", F.col("distance"), head.alias("head"), body.alias("body"),
        F.concat(head, body, F.lit(END + "\n")).alias("piece"))
    before = Window.partitionBy("_t", "leaf").orderBy(F.desc("distance")).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head"))
    span = F.when(F.col("role") == trained, F.struct("start", (F.col("start") + F.char_length("body")).alias("end")))
    item = F.struct((-F.col("distance")).alias("at"), F.col("piece"), span.alias("span"))
    return (
        placed.groupBy("_t", "tree", "leaf", "rank").agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select(
            "tree", "leaf", "rank", F.concat_ws("", F.transform("items", lambda x: x["piece"])).alias("formatted"),
            F.filter(F.transform("items", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"))
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.regexp_extract(p, r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*+)\n", 1)).alias("role"),
        unescape(F.regexp_replace(p, r"(?s)^<\|im_start\|>(?:[^\\\n]|\\.)*+\n", "")).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
