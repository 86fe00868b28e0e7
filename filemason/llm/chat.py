"""Chat formatting: reply trees, ranked branches, and one formatted conversation per chosen path."""

from __future__ import annotations

import re
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import rank_in_group

TURN, MARK, END = "### ", "###", "</turn>\n"
#: What a text must not hold unescaped: a backslash goes behind each escape character and into each control string.
_SPECIAL = r"\\|#(?=##)|<(?=/turn>)"
_ROLE_SPECIAL = r"[\\:#<\n]"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)", re.S)


def escape(text: Column) -> Column:
    """Text in which neither ``###`` nor ``</turn>`` occurs; ``unescape`` gives the original back."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPECIAL, r"$0\\")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(F.coalesce(role, F.lit("")), _ROLE_SPECIAL, r"\\$0")


def unescape(text: str) -> str:
    """Reverse of both escapes: a role's backslash stands before the character it protects, and a text's
    backslash behind an escape character or inside a control string; a pair of backslashes is one."""
    return re.sub(r"\\(.?)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    found = (_TURN.fullmatch(t) for t in formatted.split(END)[:-1])
    return [(unescape(m[1]), unescape(m[2])) for m in found]


def _jumps(nodes: DataFrame) -> DataFrame:
    """(node, up) for nodes whose parent is another existing message."""
    known = nodes.select(F.col("_node").alias("_up"))
    return nodes.where("_up <> _node").select("_node", "_up").join(known, "_up").select("_node", "_up")


def reply_paths(nodes: DataFrame) -> DataFrame:
    """(_leaf, _node, _dist) for every message on the path from a leaf up to its root.

    ``nodes`` has unique ``_node`` and ``_up`` keys. Self-joins double the reach each round: with the
    ancestors up to 2^k steps above every leaf and the 2^k-step jumps of all messages, round k adds the next
    2^k ancestors, so a chain of n messages takes log2(n) rounds. Each round is a table in the shared
    folder. Messages on or below a cycle have no root and are on no path.
    """
    jump = materialize(_jumps(nodes), "jumps")
    leaves = nodes.select("_node").join(jump.select(F.col("_up").alias("_node")), "_node", "left_anti")
    first, paths, reach = jump, leaves.select(F.col("_node").alias("_leaf"), "_node", F.lit(0).cast("long").alias("_dist")), 1
    most = None
    while jump.take(1):
        most = ceil(log2(max(2, nodes.count()))) + 1 if most is None else most - 1
        if most == 0:  # only cycles are longer than the number of messages
            roots = nodes.select("_node").join(first.select("_node"), "_node", "left_anti")
            return paths.join(paths.join(roots, "_node", "left_semi").select("_leaf"), "_leaf", "left_semi")
        higher = paths.join(jump, "_node").select("_leaf", F.col("_up").alias("_node"), (F.col("_dist") + reach).alias("_dist"))
        paths = materialize(paths.unionByName(higher), "paths")
        above = jump.select(F.col("_node").alias("_up"), F.col("_up").alias("_above"))
        jump = materialize(jump.join(above, "_up").select("_node", F.col("_above").alias("_up")), "jumps")
        reach *= 2
    return paths


def format_conversations(messages: DataFrame, tree: str = "tree_id", message: str = "message_id", parent: str = "parent_id",
                         role: str = "role", text: str = "text", score: str | None = "score",
                         paths_per_tree: int | None = None, trained_role: str = "assistant") -> DataFrame:
    """One conversation for each chosen root-to-leaf path of the reply trees.

    Returns ``tree_id, leaf_id, path_rank, n_turns, formatted, loss_spans`` under these names, whatever
    other columns ``messages`` has. Replies to one message are ranked by score (highest first, null last,
    then by message), and paths by their branches' ranks from the root on; ``paths_per_tree`` keeps the best
    ones, None all. ``loss_spans`` are the (start, end) code points of the escaped texts of ``trained_role``.

    Null text and role are empty. A null message id can't be replied to, a null tree id is a tree of
    its own, a parent that doesn't exist makes a root. Of rows with the same tree and message id the
    smallest (parent, role, text, score) counts. Cycles have no root and come out nowhere. No rows, no result.
    """
    key = lambda c: F.to_json(F.struct(F.col(tree).alias("t"), F.col(c).alias("m")))
    own = F.when(F.col(message).isNull(), F.concat(F.lit("-"), F.monotonically_increasing_id())).otherwise(key(message))
    up = F.when(F.col(parent).isNotNull(), key(parent))
    rank = F.col(score).cast("double") if score else F.lit(None).cast("double")
    body = F.struct(up.alias("_up"), F.col(role).alias("_role"), F.col(text).alias("_text"), rank.alias("_score"),
                    F.col(tree).alias("_tree"), F.col(message).alias("_message"))
    keyed = messages.select(own.alias("_node"), body.alias("_body"))
    nodes = materialize(keyed.groupBy("_node").agg(F.min("_body").alias("_body")).select("_node", "_body.*"), "messages")
    paths = reply_paths(nodes.select("_node", "_up"))

    place = F.coalesce("_up", F.to_json(F.struct("_tree")))
    ranked = rank_in_group(nodes.select("_node", "_score", place.alias("_place")), ["_place"],
                           [F.desc_nulls_last("_score"), "_node"], "_branch")
    steps = F.sort_array(F.collect_list(F.struct((-F.col("_dist")).alias("d"), "_branch")))
    leaves = paths.join(ranked.select("_node", "_branch"), "_node").groupBy("_leaf").agg(
        F.transform(steps, lambda s: s["_branch"]).alias("_branches"))
    leaves = leaves.join(nodes.select(F.col("_node").alias("_leaf"), "_tree", "_message"), "_leaf")
    leaves = rank_in_group(leaves, ["_tree"], ["_branches", "_leaf"], "_path_rank")
    if paths_per_tree is not None:
        leaves = leaves.where(F.col("_path_rank") <= paths_per_tree)

    header = F.concat(F.lit(TURN), _escape_role(F.col("_role")), F.lit(": "))
    escaped = escape(F.col("_text"))
    turns = paths.join(nodes.select("_node", F.coalesce("_role", F.lit("")).alias("_role"), header.alias("_header"),
                                    escaped.alias("_escaped")), "_node")
    turns = turns.withColumn("_turn", F.concat("_header", "_escaped", F.lit(END)))
    upward = Window.partitionBy("_leaf").orderBy(F.desc("_dist"))
    before = F.coalesce(F.sum(F.length("_turn")).over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("_start", before + F.length("_header"))
    span = F.when(F.col("_role") == trained_role, F.struct(
        F.col("_start").cast("long").alias("start"), (F.col("_start") + F.length("_escaped")).cast("long").alias("end")))
    together = turns.groupBy("_leaf").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_start", "_turn"))), lambda t: t["_turn"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return together.join(leaves, "_leaf").select(
        F.col("_tree").alias("tree_id"), F.col("_message").alias("leaf_id"), F.col("_path_rank").alias("path_rank"),
        "n_turns", "formatted", "loss_spans")
