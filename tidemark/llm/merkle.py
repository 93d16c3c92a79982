"""Merkle manifests of datasets: a tree of digests for each source, a tree over their roots, and proofs for every row.

Superblock reduction: nodes are bucketed by ``index div fanout^depth``; a group of one bucket collapses ``depth`` levels at
once, and the roots of buckets are reduced in the same way until each tree has one node. Proofs come down the same tables:
a bucket adds its own levels to what was found above it. Siblings are held once a bucket, never once a row, and no task
sees more than ``fanout^depth`` nodes of a tree at a time.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, lasting

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """The text of a value that a leaf is made of: ``-`` for null, else its UTF-8 bytes' number, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row: lowercase hex of the sha256 of its fields."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _rows_up(nodes: list[str], n: int, fanout: int, depth: int) -> list[list[str]]:
    """The rows of a bucket's digests, from its nodes up to its root. n: nodes of the whole tree at this level."""
    rows, whole = [nodes], n <= fanout**depth  # of a tree that fits one bucket, as many levels as it has
    while len(rows[-1]) > 1 if whole else len(rows) <= depth:
        below = rows[-1]
        rows.append([_digest("".join(below[a : a + fanout])) for a in range(0, len(below), fanout)])
    return rows


def _path(rows: list[list[str]], at: int, fanout: int) -> tuple[list[int], list[str]]:
    """For each level of a bucket: a node's place in its run, and the others of the run, left to right."""
    places, siblings = [], []
    for row in rows[:-1]:
        start = at // fanout * fanout
        places.append(at - start)
        siblings.append("".join(row[start:at] + row[at + 1 : start + fanout]))
        at //= fanout
    return places, siblings


def fold(node: str, places, siblings) -> str:
    """The root that a node and its proof lead to."""
    for place, others in zip(places, siblings, strict=True):
        node = _digest(others[: 64 * place] + node + others[64 * place :])
    return node


def numbered(nodes: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """nodes with (i, n), the place from 0 in the order of (tree, *order) and the number of nodes of each tree; and the table it reads.

    Rows are dealt out by ranges of the order, so that a large tree lies on many tasks; a tree's places in a range start
    behind the rows of the ranges before it. Rows that are equal in all of the order are alike and may change places.
    """
    spread = nodes.withColumn("_tie", F.monotonically_increasing_id())  # equal rows may be many: they are dealt out too
    keys = ["tree", *order, "_tie"]
    ranged = lasting(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    ranged_by = ranged.withColumn("_range", F.shiftright("_at", 33))
    runs = ranged_by.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("tree", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n"))
    placed = ranged_by.join(starts, ["tree", "_range"]).withColumn("i", F.col("_at") + F.col("_shift"))
    return placed.drop("_range", "_at", "_shift"), ranged


@dataclass(frozen=True)
class Forest:
    """Tables of nodes (tree, i, n, node, ...) from the leaves up to one root a tree, each a reduction of the one before."""

    tables: list[DataFrame]
    fanout: int
    depth: int
    parts: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return self.tables[-1].select("tree", "node")


def grown(nodes: DataFrame, *order: str, fanout: int = 16, depth: int = 2) -> Forest:
    """The trees over nodes (tree, node, ...), each in the given order."""
    placed, table = numbered(nodes, *order)
    tables, parts, width = [placed], [table], fanout**depth

    def collapse(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("i")
        n, at = int(block["n"].iloc[0]), int(block["i"].iloc[0]) // width
        root = _rows_up(block["node"].tolist(), n, fanout, depth)[-1][0]
        return pd.DataFrame({"tree": block["tree"].iloc[:1].tolist(), "i": [at], "n": [-(-n // width)], "node": [root]})

    most = placed.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = tables[-1].select("tree", "i", "n", "node")
        tables.append(lasting(below.groupBy("tree", F.expr(f"i div {width}").alias("block")).applyInPandas(collapse, "tree string, i long, n long, node string")))
        parts.append(tables[-1])
        most = -(-most // width)
    return Forest(tables, fanout, depth, parts)


def _descend(forest: Forest, level: int, paths: DataFrame, emit, schema: str, more: list[str]) -> DataFrame:
    """What ``emit`` makes of the nodes of a level and the paths (tree, i, places, siblings, ...) of the buckets above them."""
    fanout, depth = forest.fanout, forest.depth

    def together(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("i")
        rows = _rows_up(nodes["node"].tolist(), int(nodes["n"].iloc[0]), fanout, depth)
        return emit(nodes, [_path(rows, at, fanout) for at in range(len(nodes))], above.iloc[0])

    nodes = forest.tables[level].select("tree", "i", "n", "node", *more)
    blocks = nodes.groupBy("tree", F.expr(f"i div {fanout**depth}").alias("block"))
    buckets = paths.withColumns({"_tree": F.col("tree").alias("_tree"), "_bucket": F.col("i").alias("_bucket")}).drop("tree", "i")  # a lone node's path is of its own table
    return blocks.cogroup(buckets.groupBy("_tree", "_bucket")).applyInPandas(together, schema)


def _to_leaves(forest: Forest, paths: DataFrame, emit, schema: str, more: list[str], carried: list[str]) -> DataFrame:
    """Paths of the roots carried down to the leaves; the buckets between keep their columns ``carried``."""

    def between(nodes: pd.DataFrame, own: list, above: pd.Series) -> pd.DataFrame:
        made = {"tree": nodes["tree"].tolist(), "i": nodes["i"].tolist(), "places": [[*p, *above["places"]] for p, _ in own], "siblings": [[*s, *above["siblings"]] for _, s in own]}
        return pd.DataFrame(made | {c: [above[c]] * len(nodes) for c in carried})

    kind = ", ".join(["tree string, i long, places array<int>, siblings array<string>", *(f"{c} string" for c in carried)])
    for level in range(len(forest.tables) - 2, 0, -1):
        paths = _descend(forest, level, paths, between, kind, [])
    return _descend(forest, 0, paths, emit, schema, more)


@dataclass(frozen=True)
class Manifest:
    """A forest of one tree a source, and the tree over their roots."""

    sources: Forest
    top: Forest

    def roots(self) -> DataFrame:
        """(source, subroot, root) for every source."""
        named = self.sources.roots.withColumnRenamed("node", "subroot")
        root = self.top.roots.select(F.col("node").alias("root"))
        source = F.when(F.col("tree") != "", F.expr("substr(tree, 2)"))
        return named.select(source.alias("source"), "subroot").join(F.broadcast(root), F.lit(True), "left")  # root: one row

    def source_paths(self) -> DataFrame:
        """(tree, i, places, siblings, subroot, root): the way from each source's root to the root."""
        start = self.top.tables[-1].select("tree", F.lit(0).cast("long").alias("i"), F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("siblings"), F.col("node").alias("root"))

        def emit(nodes: pd.DataFrame, own: list, above: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({"tree": nodes["name"].tolist(), "i": [0] * len(nodes), "places": [[*p, *above["places"]] for p, _ in own], "siblings": [[*s, *above["siblings"]] for _, s in own], "subroot": nodes["node"].tolist(), "root": [above["root"]] * len(nodes)})

        return _to_leaves(self.top, start, emit, "tree string, i long, places array<int>, siblings array<string>, subroot string, root string", ["name"], ["root"])

    def proofs(self) -> DataFrame:
        """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each leaf.

        proof_sha256 is the digest of all siblings on the way up. folded_root is computed anew from the row's ``now``,
        the digest that it has at present, and the siblings of the manifest.
        """

        def emit(nodes: pd.DataFrame, own: list, above: pd.Series) -> pd.DataFrame:
            upper, places, siblings = "".join(above["siblings"]), list(above["places"]), list(above["siblings"])
            proofs = [_digest("".join(s) + upper) for _, s in own]
            folded = [fold(now, p + places, s + siblings) for now, (p, s) in zip(nodes["now"], own)]
            made = {"id": nodes["id"].tolist(), "leaf": nodes["node"].tolist(), "subroot": [above["subroot"]] * len(nodes), "root": [above["root"]] * len(nodes), "proof_sha256": proofs, "folded_root": folded}
            return pd.DataFrame(made | {"verified": [f == above["root"] for f in folded]})

        schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return _to_leaves(self.sources, self.source_paths(), emit, schema, ["id", "now"], ["subroot", "root"])

    def forget(self) -> None:
        """Deletes the tables of the manifest."""
        forget(*self.sources.parts, *self.top.parts)


def build_manifest(leaves: DataFrame, fanout: int = 16, depth: int = 2) -> Manifest:
    """The manifest of leaves (source, id as order, node, now).

    Leaves of a source ascend by id, then digest: a null id comes first, rows that repeat an id are ordered by their
    digests, and equal rows are leaves of their own. Sources ascend by their UTF-8 bytes, a null one first. While a row
    of nodes has more than one, every ``fanout`` consecutive ones, the last run's rest too, become one. A lone leaf is
    its source's root, a lone source's root the root. An empty table has no sources and no root.
    """
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = lasting(leaves.select(tree.alias("tree"), F.col("id").alias("at"), F.col("id").cast("string").alias("id"), "node", "now"))
    sources = grown(rows, "at", "node", fanout=fanout, depth=depth)
    forget(rows)
    tops = sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    return Manifest(sources, grown(tops, "name", fanout=fanout, depth=depth))


def document_leaves(docs: DataFrame, changed: Column | None = None, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, id, node, now): each row's digest, and the digest it has after its text was lower-cased where ``changed``.

    Nulls stay nulls, so a row without a text does not change. Columns that are not named are not read.
    """
    node = leaf(*(F.col(c) for c in columns))
    now = node if changed is None else F.when(F.coalesce(changed, F.lit(False)), leaf(*(lowered(F.col(c)) if c == text_col else F.col(c) for c in columns))).otherwise(node)
    return docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), node.alias("node"), now.alias("now"))
