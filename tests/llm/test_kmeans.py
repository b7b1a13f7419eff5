"""Drift-bounded k-means against plain Lloyd rounds, and the tightened bound against sampled points."""

import hashlib

import numpy as np
import pytest

from logloom.llm.kmeans import _tightened, cluster_report, drift_kmeans, hash_seeds, integer_vectors


def brute(vectors, seeds, rounds):
    """Plain Lloyd: scan everything, exact integer floor means, ties to the smaller number."""
    v, c = np.array(vectors, np.int64), np.array(seeds, np.int64)
    for r in range(rounds + 1):
        d2 = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        a = d2.argmin(axis=1)
        if r < rounds:
            c = np.array([v[a == j].sum(axis=0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    return a, d2[np.arange(len(v)), a], c


def test_bound_holds_for_points_of_the_sphere():
    rng = np.random.default_rng(0)
    for _ in range(200):
        old = rng.normal(size=(4, 5)) * 10
        new = old + rng.normal(size=(4, 5)) * rng.uniform(0, 5)
        radii = rng.uniform(0, 8, size=4)
        bound = _tightened(old, new, radii)
        drift = np.linalg.norm(new - old, axis=1)
        assert (bound <= drift * (1 + 1e-6) + 1e-6).all()
        for a in range(4):
            x = rng.normal(size=(500, 5))
            x = old[a] + x / np.linalg.norm(x, axis=1)[:, None] * radii[a] * rng.uniform(0, 1, size=(500, 1)) ** 0.2
            fall = np.linalg.norm(x[:, None] - old[None], axis=2) - np.linalg.norm(x[:, None] - new[None], axis=2)
            assert (fall.max(axis=0) <= bound[a] + 1e-9).all()


def test_bound_is_tighter_than_drift_aside():
    old = np.array([[0.0, 0.0], [10.0, 0.0]])
    new = np.array([[0.0, 0.0], [10.0, 3.0]])  # centroid 1 moves at right angles to the way to sphere 0
    assert _tightened(old, new, np.array([1.0, 1.0]))[0, 1] < 0.5 * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_against_lloyd(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-60, 60, size=(6, 8))
    vectors = np.concatenate([c + rng.integers(-9, 9, size=(150, 8)) for c in centres] + [np.repeat(centres[:1], 40, axis=0)])
    rows = [(i, [int(x) for x in v], "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, cluster string").repartition(5)
    seeds = hash_seeds(df, "vec_id", "v", 5)
    order = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:5]
    assert seeds == [rows[i][1] for i in order]
    assigned, centroids = drift_kmeans(df, "v", seeds, rounds=3)
    a, d, c = brute(vectors, seeds, 3)
    got = sorted(assigned.collect())
    assert [(r["cluster"], r["distance"]) for r in got] == list(zip(a.tolist(), d.tolist()))
    assert (centroids == c).all()
    assert sum(r["scans"] for r in got) < 4 * len(rows)  # the bounds spared some scans
    report = {r["vec_id"]: r for r in cluster_report(assigned, centroids).collect()}
    assert report[0]["inertia"] == d.sum() and report[0]["cluster_inertia"] == d[a == a[0]].sum()
    assert report[0]["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[a[0]])).encode()).hexdigest()


def test_ties_empty_clusters_repeated_rows(spark):
    # Two equal seeds: the second never wins a tie and stays empty; repeated rows count twice.
    rows = [(1, [0, 0]), (2, [0, 0]), (3, [4, 0]), (3, [4, 0]), (4, [2, 0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    assigned, centroids = drift_kmeans(df, "v", [[0, 0], [0, 0], [4, 0]], rounds=2)
    a, d, c = brute([v for _, v in rows], [[0, 0], [0, 0], [4, 0]], 2)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in assigned.collect()) == sorted(zip([i for i, _ in rows], a.tolist(), d.tolist()))
    assert (centroids == c).all() and 1 not in a


def test_empty_table_and_odd_vectors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, [0.5, None]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.99, -0.01])], "vec_id long, e array<double>")
    kept = df.select("vec_id", integer_vectors(F.col("e"), 2).alias("v")).where("v IS NOT NULL")
    assert [(r[0], r[1]) for r in kept.collect()] == [(5, [63, -1])]
    assigned, _ = drift_kmeans(kept.where("vec_id < 0"), "v", [[0, 0]], rounds=3)
    assert assigned.count() == 0
