"""Chat formatting over reply trees: paths from root to leaf, the best of them, and one formatted conversation each."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, lasting, map_whole

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Control strings of this and other templates, and the escape sign; each gets an escape sign behind its first character.
_CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\])|\|(?=>)")
#: So many joins of a walk go into one plan, and trees of more rounds than this are looked through for cycles.
_TOGETHER = 4
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + MIDDLE + r"(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    """The text without any control string; ``unescape`` gives it back whole."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    out, at = [], 0
    while (i := text.find("\\", at)) >= 0:
        out.append(text[at:i])
        if text[i + 1 : i + 2] == "\\":
            out.append("\\")
            at = i + 2
        else:
            at = i + 1
    return "".join(out) + text[at:]


def _role(role: str) -> str:
    """A role on one line: what could end it or look like a control string is written as %XX."""
    return re.sub(r"[%\n<\[|]", lambda m: f"%{ord(m[0]):02X}", role)


def format_turns(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it that count for the loss: the texts of the learned role."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{_role(role)}{MIDDLE}", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(re.sub("%(..)", lambda x: chr(int(x[1], 16)), m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _key():
    """The tree's id in a struct, which is never null itself, so that joins match null ids too."""
    return F.struct("tree_id").alias("tree_id")


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_id, branch, depth, node_id): the ``branches`` best paths of each tree from its root to a leaf.

    ``nodes`` has tree_id, node_id, parent_id (null at a root) and score (null: 0); node ids are unique within a tree.
    A path is as good as the mean score of its nodes; ties go to the smaller leaf id. Self-joins by pointer doubling
    carry in about log2(depth) rounds the sum of scores from every leaf to its root, one row a leaf, and only the paths
    that are chosen by it are unfolded into nodes. A parent that is missing makes its child a root. A null tree_id is the
    name of a tree like any other. Trees without a root (cycles) give nothing.
    """
    nodes = nodes.select(_key(), "node_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    have = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(1).alias("known"), F.col("score").alias("above"))
    nodes = lasting(nodes.join(have, ["tree_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("known") == 1, F.col("parent_id"))).drop("known"))
    # jumps[k]: the ancestor 2**k steps up, and the sum of scores on the way, the ancestor's included and the node's own not.
    jumps = [nodes.where("parent_id is not null").select("tree_id", "node_id", F.col("parent_id").alias("up"), F.col("above").alias("score"))]
    largest, endless = None, None
    while True:
        last = jumps[-1]
        step = last.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"))
        far = lasting(last.join(step, ["tree_id", "up"]).select("tree_id", "node_id", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score")))
        if not far.take(1):
            forget(far)
            break
        if largest is None and len(jumps) >= _TOGETHER:  # shallow trees without cycles need no sizes
            largest = nodes.groupBy("tree_id").count().agg(F.max("count")).first()[0]
        if largest is not None and 1 << len(jumps) > largest:  # a node with more ancestors than its tree has nodes stands below a cycle
            endless = far
            break
        jumps.append(far)
    inner = nodes.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id"))
    leaves = nodes.join(inner, ["tree_id", "node_id"], "left_anti").select("tree_id", F.col("node_id").alias("leaf"), F.col("node_id").alias("at"), F.col("score").alias("sum"), F.lit(0).cast("long").alias("top"))
    if endless is not None:
        leaves = leaves.join(endless.select("tree_id", F.col("node_id").alias("at")), ["tree_id", "at"], "left_anti").select("tree_id", "leaf", "at", "sum", "top")
    for k in range(len(jumps) - 1, -1, -1):
        jump = jumps[k].select("tree_id", F.col("node_id").alias("at"), "up", F.col("score").alias("more"))
        up = F.col("up").isNotNull()
        leaves = leaves.join(jump, ["tree_id", "at"], "left").select(
            "tree_id", "leaf", F.coalesce("up", "at").alias("at"), F.when(up, F.col("sum") + F.col("more")).otherwise(F.col("sum")).alias("sum"), F.when(up, F.col("top") + (1 << k)).otherwise(F.col("top")).alias("top")
        )
        if k and k % _TOGETHER == 0:
            leaves = lasting(leaves)
    worth = leaves.where("leaf is not null").withColumn("worth", F.col("sum") / (F.col("top") + 1))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("worth"), "leaf"))
    chosen = lasting(worth.withColumn("branch", rank).where(F.col("branch") <= branches).select("tree_id", "branch", "leaf", "top"))
    paths = chosen.select("tree_id", "branch", F.col("leaf").alias("node_id"), F.col("top").alias("depth"))
    for k in range(len(jumps) - 1, -1, -1):
        # Each node of a path and, where it has one, its ancestor: a round has as many partitions as the one before.
        here = F.struct("node_id", "depth")
        above = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node_id"), (F.col("depth") - (1 << k)).alias("depth")))
        both = F.filter(F.array(here, above), lambda x: x.isNotNull())
        paths = paths.join(jumps[k].select("tree_id", "node_id", "up"), ["tree_id", "node_id"], "left").select("tree_id", "branch", F.inline(both))
        if k % _TOGETHER == 0:
            paths = lasting(paths)
    return paths.select(F.col("tree_id.tree_id").alias("tree_id"), "branch", "depth", "node_id")


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_id, branch, formatted, loss_spans): one formatted conversation for each chosen path.

    ``nodes`` also has role and text; nulls count as empty. Trees without a root (cycles) give nothing. An empty table
    gives an empty table. A conversation is one row, so its turns meet in one task and have to fit its memory; what a
    tree holds beside the chosen branches does not.
    """
    nodes = lasting(nodes.select("tree_id", "node_id", "parent_id", "score", "role", "text"))  # read three times, made once
    paths = best_paths(nodes, branches).withColumn("tree_id", _key())
    turns = paths.join(nodes.select(_key(), "node_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree_id", "node_id"])
    each = turns.groupBy(F.col("tree_id.tree_id").alias("tree_id"), "branch").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in frame["turns"]]
            spans = pd.Series([[{"start": a, "end": b} for a, b in x] for _, x in made], dtype=object, index=frame.index)
            yield frame[["tree_id", "branch"]].assign(formatted=[x for x, _ in made], loss_spans=spans)

    return map_whole(each, write, "branch int, formatted string, loss_spans array<struct<start:int,end:int>>", "tree_id")


def thread_nodes(messages: DataFrame) -> DataFrame:
    """Nodes of conversations that are rows by turn (conv_id, turn, role, text): each message answers the one before.

    Rows with equal turns follow each other by role and text, a null turn comes first, and repeated rows stay.
    """
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return messages.select(F.col("conv_id").alias("tree_id"), at.alias("node_id"), "role", "text").withColumn(
        "parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    ).withColumn("score", F.lit(0.0))


def read_back(formatted: DataFrame, learned: str = "assistant") -> DataFrame:
    """(tree_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read from the formatted text."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, spans in zip(frame["formatted"], frame["loss_spans"]):
                turns = read_turns(text)
                all_turns = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                digest = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (all_turns, loss)]
                rows.append((len(turns), digest[0], len(loss), digest[1], len(text)))
            made = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            made.insert(0, "tree_id", frame["tree_id"].to_numpy())
            yield made

    return map_whole(formatted, read, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", "tree_id")
