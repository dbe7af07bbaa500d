"""Chat formatting of reply trees.

A conversation is a tree of messages (node, parent).  Root-to-leaf paths are enumerated by
iterative self-joins that double: after step k every node knows its ancestor 2^k messages up
and the messages between, so a tree of depth d takes log2(d) joins, on (conversation, node)
keys and never on all pairs of a conversation; a message that knows its root is joined no more.  A leaf's path is a branch; branches are ranked
by the sum of their messages' scores (ties: the longer, then the smaller leaf) and the best
``keep`` of each conversation are formatted, each as one conversation.

Template: every turn is ``<s>[role]\\n`` text ``</s>\\n``.  Inside roles and texts the backslash
and the four characters that the template's and other templates' control strings are made of
are written as a backslash and a letter, so no text can end a turn or open another, and the
writing is undone exactly (:func:`unescape`).  The loss mask is the list of (start, length), in
code points of the formatted string, of the assistant texts.

Null texts and null roles are empty.  Rows with a null conversation form one conversation; rows
that share a conversation and a node are numbered apart by their role and text.  A message whose parent
is missing is a root; messages on a cycle reach no root and are left out.  An empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.llm.common import written

# Escaped character and the letter that follows the backslash; the backslash is
# escaped first and unescaped last.
ESCAPES = (("\\", "e"), ("<", "l"), (">", "g"), ("[", "o"), ("]", "c"))


def escape(text: Column) -> Column:
    for char, letter in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescape(text: Column) -> Column:
    for char, letter in reversed(ESCAPES):
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return text


def linear_tree(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """Messages of conversations that are lists of turns: each turn's parent is the one before.

    Returns (conv, node, parent, role, text, score); nodes are numbered from 0 by turn, ties by
    role and text; the score of a message is 1, so a branch's score is its length."""
    named = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                         F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                         F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    node = (F.row_number().over(order) - 1).cast("bigint")
    return named.select("conv", node.alias("node"), F.when(node > 0, node - 1).alias("parent"), "role", "text",
                        F.lit(1.0).alias("score"))


def branches(messages: DataFrame) -> DataFrame:
    """All root-to-leaf paths: (conv, leaf, path of nodes from the root, score).

    Iterative self-joins on narrow rows: texts are not carried."""
    key = ["conv", "node"]
    nodes = messages.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("conv").alias("c"), F.col("node").alias("p"))
    has = F.col("p").isNotNull()
    state = nodes.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p")), "left").select(
        *key, F.col("p").alias("up"), F.array("node").alias("path"), "score")
    state = written(state, "tree")
    leaves = written(state.select(*key).join(
        state.filter("up is not null").select(F.col("conv").alias("c"), F.col("up").alias("p")).distinct(),
        F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti"), "leaves")
    # messages whose path reaches a root are done; only the others are joined again
    done, pending, total, step = state.filter("up is null"), state.filter("up is not null"), nodes.count(), 0
    while 2 ** step <= total and pending.limit(1).count():
        above = done.union(pending).select(F.col("conv").alias("c"), F.col("node").alias("p"), F.col("up").alias("top"),
                                           F.col("path").alias("front"), F.col("score").alias("more"))
        joined = pending.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("p")), "left")
        longer = written(joined.select(
            *key, F.col("top").alias("up"),
            F.when(has, F.concat("front", "path")).otherwise(F.col("path")).alias("path"),
            (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")), f"tree-{step}")
        done, pending = done.union(longer.filter("up is null")), longer.filter("up is not null")
        step += 1
    full = done.alias("s").join(leaves.alias("l"), F.expr("s.conv <=> l.conv and s.node = l.node"), "left_semi")
    return full.select("conv", F.col("node").alias("leaf"), "path", "score")


def best_branches(paths: DataFrame, keep: int = 1) -> DataFrame:
    """The best ``keep`` branches of each conversation, with their rank."""
    order = Window.partitionBy("conv").orderBy(F.desc("score"), F.desc(F.size("path")), F.asc("leaf"))
    return paths.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def format_branches(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per branch: conv, leaf, rank, score, formatted, loss_mask."""
    steps = paths.select("conv", "leaf", "rank", "score", F.posexplode("path").alias("at", "node"))
    texts = messages.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text")
    turns = steps.join(texts, F.expr("conv <=> c and node = n"))
    head = F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]\n"))
    turns = turns.select("conv", "leaf", "rank", "score", F.struct(
        "at", F.concat(head, escape(F.col("text")), F.lit("</s>\n")).alias("turn"), F.length(head).alias("skip"),
        F.length(escape(F.col("text"))).alias("size"), (F.col("role") == "assistant").alias("loss")).alias("t"))
    size = lambda t: F.length(t["turn"])
    # a turn's place is the running sum of the turns before it
    before = Window.partitionBy("conv", "leaf").orderBy("t.at").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("from", F.coalesce(F.sum(F.length("t.turn")).over(before), F.lit(0)).cast("int"))
    rows = placed.groupBy("conv", "leaf", "rank", "score").agg(F.sort_array(F.collect_list(F.struct(
        F.col("t.at").alias("at"), F.col("t.turn").alias("turn"), F.col("t.loss").alias("loss"),
        (F.col("from") + F.col("t.skip")).alias("start"), F.col("t.size").alias("length")))).alias("turns"))
    return rows.select("conv", "leaf", "rank", "score", F.array_join("turns.turn", "").alias("formatted"),
                       F.transform(F.filter("turns", lambda t: t["loss"]),
                                   lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pattern = F.lit(r"<s>\[([^\]]*)\]\n([^<]*)</s>\n")
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(formatted, pattern, F.lit(1)).alias("role"),
                     F.regexp_extract_all(formatted, pattern, F.lit(2)).alias("text")),
        lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"])))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """Every conversation of a table of turns, formatted: (conv, leaf, rank, score, formatted, loss_mask)."""
    messages = written(linear_tree(turns, conv_col, turn_col, role_col, text_col), "messages")
    return format_branches(messages, best_branches(branches(messages)))
