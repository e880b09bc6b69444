"""Reply trees as conversations.

Each node of a tree names its parent. Self-joins that double the distance (to the parent, the
grandparent, the fourth ancestor, ...) pair every leaf with all nodes above it, in a number of joins
that grows with the logarithm of the depth. Branches are ranked in their tree by the sum of their
nodes' scores, and each chosen one is formatted as one conversation.

The template: ``<s>``, role, newline, text, ``</s>``, newline for each turn. Inside roles and texts the
characters that control strings begin with are escaped, so no control string is left there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stored

BEGIN, END = "<s>", "</s>"
LEARNT = "assistant"
#: What is escaped, by what.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\n": "\\n"}
TURN = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escaped(text: Column, with_newline: bool = False) -> Column:
    for plain, code in ESCAPES.items():
        if plain != "\n" or with_newline:
            text = F.replace(text, F.lit(plain), F.lit(code))
    return text


_PLAIN = {code: plain for plain, code in ESCAPES.items()}


def unescaped(text: str) -> str:
    return re.sub(r"\\.", lambda m: _PLAIN[m[0]], text)


def branches(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, depth, role, text, score): every node of every root-to-leaf path, the root at depth 0.

    ``nodes``: tree, node, parent, role, text, score. A node whose parent is null or missing is a root.
    Nodes that never reach a root (a cycle) are in no path. Of a node that repeats, the row that comes first by
    parent, role, text and score is kept.
    """
    picked = nodes.select("tree", "node", "parent", "role", "text", "score").filter(
        F.col("tree").isNotNull() & F.col("node").isNotNull())
    first = F.row_number().over(Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score"))
    nodes = stored(picked.withColumn("nth", first).filter("nth = 1").drop("nth"), "tree-nodes")
    known = nodes.select("tree", F.col("node").alias("parent"))
    links = nodes.select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi")
    parents = links.select("tree", F.col("parent").alias("node")).distinct()
    leaves = nodes.select("tree", "node").join(parents, ["tree", "node"], "left_anti")
    # above: a leaf and the nodes fewer than ``step`` over it; jump: a node and the one ``step`` over it.
    above = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("over"))
    jump = stored(links.select("tree", "node", F.col("parent").alias("to")), "tree-jumps")
    above, step, most = stored(above, "tree-paths"), 1, nodes.count()
    while step <= most and not jump.isEmpty():
        higher = above.join(jump, ["tree", "node"]).select(
            "tree", "leaf", F.col("to").alias("node"), (F.col("over") + step).alias("over"))
        above = stored(above.unionByName(higher), "tree-paths")
        on = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        jump = stored(jump.join(on, ["tree", "to"]).select("tree", "node", F.col("next").alias("to")), "tree-jumps")
        step *= 2
    if step > most:  # what can still jump that far goes in a circle
        looping = jump.select("tree", F.col("node").alias("leaf")).distinct()
        above = above.join(looping, ["tree", "leaf"], "left_anti")
    return above.join(nodes.drop("parent"), ["tree", "node"]).select(
        "tree", "leaf", (-F.col("over")).alias("depth"), "role", "text", "score")


def best_branches(paths: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, turns): one row for each branch, its turns from the root on; ranked by
    score, ties to the smaller leaf. ``keep``: how many of each tree; None: all."""
    turn = F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = paths.groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
    ranked = whole.withColumn("rank", F.row_number().over(order))
    return (ranked if keep is None else ranked.filter(F.col("rank") <= keep)).select(
        "tree", "leaf", "rank", "score", "turns")


def formatted(chosen: DataFrame) -> DataFrame:
    """``chosen`` with ``conversation``, and ``loss``: the (start, end) of what a model learns from, in
    code points of ``conversation``: the escaped texts of the assistant."""
    def written(t: Column) -> Column:
        return F.concat(F.lit(BEGIN), escaped(t["role"], True), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n"))

    parts = F.transform("turns", lambda t: F.struct(
        written(t).alias("part"), F.length(escaped(t["text"])).alias("n"),
        (t["role"] == LEARNT).alias("learnt")))
    tail = len(END) + 1

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["part"])
        span = F.struct((end - tail - p["n"]).alias("start"), (end - tail).alias("end"))
        return F.struct(end.alias("at"), F.when(p["learnt"], F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return (chosen.withColumn("_parts", parts)
            .withColumn("conversation", F.array_join(F.transform("_parts", lambda p: p["part"]), ""))
            .withColumn("loss", F.aggregate("_parts", none, step)["spans"]).drop("_parts"))


def linear(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Conversations as trees of one branch: each row answers the one before it by turn. Rows with
    equal turns follow in the order of role and text. A tree is (none, id): rows with a null ``conv`` are one
    conversation as well; see ``named``."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    tree = F.struct(F.col(conv).isNull().alias("none"), F.col(conv).cast("long").alias("id"))
    picked = rows.select(tree.alias("tree"), F.col(turn).alias("turn"),
                         F.col(role).alias("role"), F.col(text).alias("text"))
    numbered = picked.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "node", (F.col("node") - 1).alias("parent"), "role", "text",
                           F.lit(0.0).alias("score"))


def named(conversations: DataFrame) -> DataFrame:
    """Conversations of ``linear`` trees, by the id they had; null stays null."""
    return conversations.withColumn("tree", F.col("tree.id"))


def read_back(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the
    formatted text and its mask alone."""
    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                text = row["conversation"]
                turns = [(unescaped(m[1]), unescaped(m[2])) for m in TURN.finditer(text)]
                all_turns = "".join(f"{role}\n{said}\n" for role, said in turns)
                learnt = "".join(unescaped(text[s["start"]:s["end"]]) for s in row["loss"])
                yield (row["tree"], len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(learnt),
                       hashlib.sha256(learnt.encode()).hexdigest(), len(text))

    return map_rows(conversations.select("tree", "conversation", "loss"), rows,
                    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                    "formatted_chars long")


def conversations(nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, turns, conversation, loss) for the ``keep`` best branches of each tree.

    Null roles and texts are empty. Rows with a null tree or node are in no branch; a null score counts
    zero. Other columns are ignored. An empty table gives no rows.
    """
    return formatted(best_branches(branches(nodes), keep))
