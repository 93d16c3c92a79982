"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The upper tree is fitted on a bounded sample. Below it come as many levels as the number of rows asks for; each has one
codebook of residuals, fitted on the same sample and shared by all nodes of the level, so leaves grow with the table and
the model does not. Every vector goes down to its leaf. A query takes leaves from a priority queue of branches by
distance. How many leaves is calibrated: some queries are answered by brute force over all rows, and visits widen until
the leaves visited hold the wanted share of the true neighbours.

Neighbouring leaves are one cell. A query is sent to a cell once, with the numbers of the leaves that it visits there, and
is compared with the rows of these leaves only.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, lasting


@dataclass
class Tree:
    """Nodes with centroids; node 0 is the root. children[i] is empty for the lowest nodes of the upper tree.

    ``levels`` are codebooks of what a vector differs by from the centroid above. A leaf's number holds the node and,
    digit by digit, its place in each level. ``above`` names for each lowest node the node whose leaves are its cell, or
    -1 where every ``span`` leaves that follow one another are a cell.
    """

    centroids: np.ndarray
    children: list[list[int]]
    levels: list[np.ndarray] = field(default_factory=list)
    span: int = 1
    above: np.ndarray | None = None

    def count(self) -> int:
        return sum(not c for c in self.children) * math.prod(map(len, self.levels))

    def cells(self, leaves: np.ndarray) -> np.ndarray:
        """The cell of each leaf: not negative for spans, -1 - node for the leaves below a node."""
        if self.above is None:
            return leaves
        above = self.above[leaves // math.prod(map(len, self.levels))]
        return np.where(above < 0, leaves // self.span, -1 - above)

    def assign(self, units: np.ndarray) -> np.ndarray:
        """The leaf that each vector comes to by always taking the nearest branch."""
        at = np.zeros(len(units), np.int64)
        todo = [(0, np.arange(len(units)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                at[rows] = node
                continue
            kids = np.array(self.children[node])
            near = kids[_nearest(units[rows], self.centroids[kids])]
            todo += [(k, rows[near == k]) for k in kids if (near == k).any()]
        rest = units - self.centroids[at]
        for book in self.levels:
            near = _nearest(rest, book)
            at, rest = at * len(book) + near, rest - book[near]
        return at

    def visits(self, unit: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order: the open branch whose centroid is nearest goes first."""
        far = ((self.centroids - unit) ** 2).sum(axis=1)
        turn = itertools.count()
        queue: list[tuple] = [(0.0, next(turn), 0, -1, None)]
        while queue:
            _, _, node, depth, rest = heapq.heappop(queue)
            if depth < 0 and self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (far[kid], next(turn), kid, -1, None))
                continue
            depth = max(depth, 0)
            if depth == len(self.levels):
                yield node
                continue
            below = (unit - self.centroids[node] if rest is None else rest) - self.levels[depth]
            for j, d in enumerate((below**2).sum(axis=1)):
                heapq.heappush(queue, (d, next(turn), node * len(below) + j, depth + 1, below[j]))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centroids)
        for j in range(k):
            if (near == j).any():
                centroids[j] = x[near == j].mean(axis=0)
    return centroids, _nearest(x, centroids)


def fit_tree(sample: np.ndarray, branch: int, leaf_rows: int, seed: int = 5) -> Tree:
    """Splits the sample by k-means until a node holds ``leaf_rows`` of it at most or its vectors are all equal."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1] if sample.ndim == 2 else 0
    centroids, children = [sample.mean(axis=0) if len(sample) else np.zeros(width)], [[]]
    todo = [(0, np.unique(sample, axis=0) if len(sample) else sample)]
    while todo:
        node, x = todo.pop()
        if len(x) <= leaf_rows:
            continue
        found, near = _kmeans(x, min(branch, len(x)), rng)
        groups = [(c, x[near == j]) for j, c in enumerate(found) if (near == j).any()]
        if len(groups) < 2:
            continue
        for c, part in groups:
            children[node].append(len(children))
            centroids.append(c)
            children.append([])
            todo.append((len(children) - 1, part))
    return Tree(np.array(centroids), children)


def add_levels(tree: Tree, sample: np.ndarray, branch: int, leaves: float, seed: int = 6) -> None:
    """Puts levels of ``branch`` codes below the tree until it has so many leaves, or no difference is left to split."""
    rng = np.random.default_rng(seed)
    rest = sample - tree.centroids[tree.assign(sample)]
    while tree.count() < leaves and len(apart := np.unique(rest, axis=0)) > 1:
        book, _ = _kmeans(apart, min(branch, len(apart)), rng)
        tree.levels.append(book)
        rest = rest - book[_nearest(rest, book)]


def gather(tree: Tree, sample: np.ndarray, rows: int, block: int) -> None:
    """Puts leaves together to cells of about ``block`` of ``rows`` rows, by where the sample lies."""
    here = np.bincount(Tree(tree.centroids, tree.children).assign(sample), minlength=len(tree.children)) * (rows / len(sample))
    for node in range(len(here) - 1, 0, -1):  # children are numbered after their parents
        for kid in tree.children[node]:
            here[node] += here[kid]
    here[0] = rows
    tree.above = np.full(len(here), -1)
    for node in range(len(here)):
        if tree.above[node] < 0 and here[node] <= block:
            tree.above[node] = node
        for kid in tree.children[node]:
            tree.above[kid] = tree.above[node]
    for book in reversed(tree.levels):
        if rows * tree.span * len(book) > tree.count() * block:
            break
        tree.span *= len(book)


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors as rows, each times the power of two that brings its largest component near 1.

    That is exact and no cosine feels it, but squares neither overflow nor vanish.
    """
    if not len(column):
        return np.zeros((0, 0))
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _top(q_ids, q, ids, x, k: int) -> list[tuple[int, int, float]]:
    """(query, id, cosine) of the k ids of a block that are nearest to each query; ties go to the smaller id.

    An id counts with its best row. A product of matrices finds the candidates, and the cosine of those is summed anew in
    a fixed order, so that equal vectors get equal scores wherever they stand.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    names, starts = np.unique(ids, return_index=True)
    q_norm, x_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    out = []
    for lo in range(0, len(q), 256):
        near = (q[lo : lo + 256] / q_norm[lo : lo + 256, None]) @ (x / x_norm[:, None]).T
        by_id = near if len(names) == len(ids) else np.maximum.reduceat(near, starts, axis=1)
        for i, (row, best) in enumerate(zip(near, by_id), lo):
            best = np.where(names == q_ids[i], -np.inf, best)
            kth = np.partition(best, -k)[-k] if len(best) > k else -np.inf
            pick = np.flatnonzero((row >= kth - 1e-9) & (ids != q_ids[i]))
            score = (x[pick] * q[i]).sum(axis=1) / (x_norm[pick] * q_norm[i])
            seen: dict[int, float] = {}
            for at in np.lexsort((ids[pick], -score)):
                if len(seen) == k:
                    break
                seen.setdefault(ids[pick[at]], score[at])
            out += [(q_ids[i], name, value) for name, value in seen.items()]
    return out


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = 0.96, sample_rows: int = 20_000, branch: int = 8, leaf_rows: int = 160, most_rows: int = 1000, calibrate: int = 64, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, leaves): the ``k`` nearest found by cosine of each row whose id ``every`` divides.

    Candidates are all rows with another id. Vectors that are null, zero, of another length than most, or hold null or
    non-finite components take no part; nor do null ids. Very small and very large vectors count like others. Rows that
    repeat an id count as one item with its best score; as a query such an id asks with its smallest vector. Equal scores
    go to the smaller id. An empty table gives none.

    The upper tree is fitted on ``sample_rows`` rows by a hash of the id, and split to ``leaf_rows`` of these; levels
    below it make as many leaves as hold ``most_rows`` of all rows each. All rows are indexed. ``leaves`` is the number
    of leaves that the calibration came to; queries that those give too few neighbours widen until they have them all.
    """
    spark = vectors.sparkSession
    fine = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector_col, lambda v: v != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).first()
    width = size.n if size else 0
    rows = rows.where(F.size("v") == width)
    out = "query_id long, rank int, vec_id long, score double, leaves int"
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows).select("v").toPandas()["v"]  # bounded by sample_rows
    if not len(sample):
        return spark.createDataFrame([], out)
    units = _units(_matrix(sample))
    tree = fit_tree(units, branch, leaf_rows)
    add_levels(tree, units, branch, size["count"] / most_rows)
    gather(tree, units, size["count"], block)
    held = spark.sparkContext.broadcast(tree)  # bounded by the sample and the logarithm of the rows

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Rows that repeat id and vector are one item anyway, and most of them end here.
            frame = frame[~pd.Series(list(zip(frame["id"], (v.tobytes() for v in frame["v"]))), frame.index, dtype=object).duplicated()]
            if len(frame):
                leaf = held.value.assign(_units(_matrix(frame["v"])))
                yield frame.assign(leaf=leaf, cell=held.value.cells(leaf))

    # Rows of a cell are dealt into blocks by their own numbers, so that a repeated id does not gather in one.
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    indexed = lasting(numbered.mapInPandas(index, "id long, v array<double>, row long, leaf long, cell long"))
    queries = lasting(indexed.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    others = indexed.select("id").distinct().limit(k + 1).count() - 1
    leaves = _calibrated(indexed, queries, held, k, recall, calibrate)
    found, visits = None, leaves
    while True:
        made = _searched(indexed, queries, held, visits, k, block)
        found = made if found is None else found.unionByName(made)
        if visits >= tree.count():
            break
        enough = made.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, others))
        queries = lasting(queries.join(enough.select(F.col("query_id").alias("id")), "id", "left_anti"))
        if not queries.limit(1).count():
            break
        visits *= 4
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank)
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(leaves).alias("leaves"))


def _searched(indexed: DataFrame, queries: DataFrame, held, visits: int, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each query in the first ``visits`` leaves of its order."""

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, v, unit in zip(frame["id"], frame["v"], _units(_matrix(frame["v"])) if len(frame) else ()):
                cells: dict[int, list[int]] = {}
                seen = list(itertools.islice(held.value.visits(unit), visits))
                for leaf, cell in zip(seen, held.value.cells(np.array(seen)).tolist()):
                    cells.setdefault(cell, []).append(leaf)
                yield pd.DataFrame({"cell": list(cells), "query_id": i, "q": pd.Series([v] * len(cells), dtype=object), "leaves": pd.Series(list(cells.values()), dtype=object)})

    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a walk through the tree costs more than a row's size tells
    probes = lasting(queries.repartition(parts, "id").mapInPandas(probe, "cell long, query_id long, q array<double>, leaves array<long>"))
    # A cell's rows and the queries that visit it are both dealt into blocks, so neither a large cell nor a popular one
    # meets in one task.
    asked = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("q_blocks"))
    many = indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("v_blocks")).join(asked, "cell")
    many = lasting(many)
    number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = probes.join(many, "cell").withColumn("q_block", part("query_id", "q_blocks")).withColumn("v_block", number("v_blocks"))
    right = indexed.join(many, "cell").withColumn("v_block", part("row", "v_blocks")).withColumn("q_block", number("q_blocks"))
    key = ["cell", "v_block", "q_block"]

    def search(probes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(probes) and len(rows):
            q_ids, q, ids, x = probes["query_id"].to_numpy(), _matrix(probes["q"]), rows["id"].to_numpy(), _matrix(rows["v"])
            visitors: dict[int, list[int]] = {}
            for n, leaves in enumerate(probes["leaves"]):
                for leaf in leaves:
                    visitors.setdefault(leaf, []).append(n)
            for leaf, at in rows.groupby("leaf").indices.items():
                if who := visitors.get(leaf):
                    out += _top(q_ids[who], q[who], ids[at], x[at], k)
        found = pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        found = found.sort_values(["score", "vec_id"], ascending=[False, True], kind="stable")
        return found.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)

    found = left.groupBy(*key).cogroup(right.select("id", "v", "leaf", *key).groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = lasting(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
    forget(probes, many)
    return found


def _calibrated(indexed: DataFrame, queries: DataFrame, held, k: int, recall: float, calibrate: int) -> int:
    """The least number of leaves that hold the wanted share of the true neighbours of some queries."""
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(calibrate).collect()
    if not asked:
        return 1
    q_ids, q = np.array([r.id for r in asked]), _matrix(pd.Series([r.v for r in asked]))
    spark = indexed.sparkSession
    given = spark.sparkContext.broadcast((q_ids, q))

    def brute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            if not len(frame):
                continue
            rows = frame.reset_index(drop=True)
            found = pd.DataFrame(_top(*given.value, rows["id"].to_numpy(), _matrix(rows["v"]), k), columns=["query_id", "vec_id", "score"])
            found["leaf"] = found["vec_id"].map(dict(zip(rows["id"], rows["leaf"])))
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["score", "vec_id"], ascending=[False, True]).drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)
        if best is not None:
            yield best

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {i: n for n, i in enumerate(given.value[0])}
        for frame in frames:
            out = []
            for i, part in frame.groupby("query_id"):
                wanted = part["leaf"].value_counts().to_dict()
                for n, leaf in enumerate(held.value.visits(_units(given.value[1][at[i]][None])[0]), 1):
                    out += [n] * wanted.pop(leaf, 0)
                    if not wanted:
                        break
            yield pd.DataFrame({"place": out}, dtype="int64")

    near = indexed.mapInPandas(brute, "query_id long, vec_id long, score double, leaf long")
    near = near.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "leaf")).alias("b")).select("query_id", "vec_id", "b.*")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true = near.withColumn("rank", rank).where(F.col("rank") <= k)
    at = np.sort([r.place for r in true.repartition("query_id").mapInPandas(places, "place long").collect()])  # calibrate * k numbers
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) if len(at) else 1
