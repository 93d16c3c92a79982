"""Cells of leaves: the same neighbours however leaves are put together, and rows that repeat an id."""

import numpy as np
import pytest

from tidemark.llm import vector_tree

SCHEMA = "vec_id long, embedding array<double>"


def clustered(rng, n, kinds=40, width=16):
    middle = rng.normal(size=(kinds, width))
    return middle[rng.integers(0, kinds, n)] + 0.15 * rng.normal(size=(n, width))


def test_cells_do_not_change_the_result(spark):
    rng = np.random.default_rng(2)
    x = clustered(rng, 3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(5)
    fit = {"sample_rows": 600, "leaf_rows": 40, "most_rows": 20, "branch": 4}
    alone = sorted(map(tuple, vector_tree.nearest(df, block=25, **fit).collect()))
    cells = sorted(map(tuple, vector_tree.nearest(df, **fit).collect()))
    assert cells == alone and len(cells) == 60 * 5
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        near = u @ u[q]
        near[q] = -2
        hits += len({r[2] for r in cells if r[0] == q} & set(np.argsort(-near)[:5].tolist()))
    assert hits >= 0.9 * 60 * 5


def test_one_repeated_id_is_one_item(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 900)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    again = rows + [rows[7]] * 400 + [(7, (2 * x[7]).tolist())] * 50  # of the same direction as well
    once = {(r.query_id, r.vec_id): r.score for r in vector_tree.nearest(spark.createDataFrame(rows, SCHEMA), recall=1.0).collect()}
    found = vector_tree.nearest(spark.createDataFrame(again, SCHEMA).repartition(6), recall=1.0, block=16).collect()
    assert len(found) == 18 * 5 and len({(r.query_id, r.vec_id) for r in found}) == len(found)
    assert len(once.keys() & {(r.query_id, r.vec_id) for r in found}) >= 0.95 * len(once)
    assert all(r.score == pytest.approx(once[r.query_id, r.vec_id]) for r in found if (r.query_id, r.vec_id) in once)


def test_a_smaller_share_is_visited_as_clustered_vectors_grow(spark):
    rng = np.random.default_rng(4)
    shares = []
    for n in (2000, 16_000):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(rng, n, n // 50))], SCHEMA)
        found = vector_tree.nearest(df, leaf_rows=40, most_rows=40, every=200).limit(1).collect()
        shares.append(found[0].leaves * 40 / n)
    assert shares[1] < shares[0] / 2


def test_every_leaf_has_one_cell_of_bounded_size():
    rng = np.random.default_rng(5)
    x = clustered(rng, 4000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for most, block in ((4000, 1500), (50, 500), (50, 40), (50, 10_000)):
        tree = vector_tree.fit_tree(u[:800], 4, 100)
        vector_tree.add_levels(tree, u[:800], 4, 4000 / most)
        vector_tree.gather(tree, u[:800], 4000, block)
        leaf = tree.assign(u)
        cell = tree.cells(leaf)
        assert len(set(cell.tolist())) <= len(set(leaf.tolist()))
        assert len(set(zip(leaf.tolist(), cell.tolist()))) == len(set(leaf.tolist()))
        sizes = np.unique(cell, return_counts=True)[1]
        assert block != 10_000 or len(sizes) == 1
        assert block not in (500, 1500) or 2 < len(sizes) < len(set(leaf.tolist()))
