import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import covertree


def brute(rows, every, k):
    """rows: (vec_id, vector or None); scores by integers."""
    known = [(i, [int(x) for x in v]) for i, v in rows if v is not None]
    out = []
    for a, (qi, q) in enumerate(known):
        if qi % every == 0:
            scores = [(-sum(x * y for x, y in zip(q, v)), i) for b, (i, v) in enumerate(known) if b != a and len(v) == len(q)]
            out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x", "y") for i, v in rows], "vec_id long, v array<double>, row string, cell string")


@pytest.mark.parametrize("seed, leaf_size", [(1, 8), (2, 64)])
def test_equals_brute_force(spark, seed, leaf_size):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 9) // 1 for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(150)]  # copies of one vector: ties
    rows += [(600 + i, [c + r.randint(-1, 1) for c in rows[3][1]]) for i in range(100)]
    rows += [(800, None), (801, []), (800, []), (805, [1.0, 2.0]), (810, [3.0, -4.0]), (815, [0.0, 0.0]), (820, [7.0] * 3), (0, rows[0][1])]
    got = covertree.top_k_products(table(spark, rows), F.col("vec_id") % 5 == 0, k=7, pivots=6, block_rows=64, group_rows=16, leaf_size=leaf_size)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 7)


def test_tree_covers_and_separates():
    points = np.random.default_rng(4).normal(size=(500, 3)) * 10
    tree = covertree.CoverTree(points, np.arange(500), np.arange(500), leaf_size=8)
    assert sorted(tree.ids.tolist()) == list(range(500))
    for n, children in enumerate(tree.children):
        mine = tree.points[tree.begin[n] : tree.end[n]]
        assert (np.linalg.norm(mine - tree.centre[n], axis=1) <= tree.radius[n]).all()
        if len(children):
            centres = tree.centre[children]
            assert np.array_equal(centres[0], tree.centre[n])
            gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2) + np.eye(len(centres)) * 1e9
            assert gaps.min() > (tree.radius[n] - 1e-4) / (1 + 1e-7) / 1.3 - 1e-9
            assert tree.begin[children[0]] == tree.begin[n] and tree.end[children[-1]] == tree.end[n]


def test_integer_vectors(spark):
    nan = float("nan")
    rows = spark.createDataFrame(
        [(1, [0.5, -0.01]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [float("inf")]), (6, [])], "vec_id long, embedding array<float>"
    )
    got = {r[0]: r[1] for r in rows.select("vec_id", covertree.integer_vectors(rows)).collect()}
    assert got == {1: [32.0, -1.0], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_empty_and_few(spark):
    assert covertree.top_k_products(table(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    assert covertree.top_k_products(table(spark, [(0, [1.0])]), F.col("vec_id") % 5 == 0).count() == 0
    assert covertree.top_k_products(table(spark, [(1, [1.0])]), F.col("vec_id") % 5 == 0).count() == 0
