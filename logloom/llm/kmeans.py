"""Centroid clustering (Lloyd rounds) with bounds that drift geometry tightens.

Every vector carries its cluster ``a``, an upper bound ``u`` on its distance to the centroid of ``a`` and one lower bound
``l[j]`` on its distance to every centroid ``j``. When the centroids move, ``u`` grows by the full drift of its own
centroid, but ``l[j]`` shrinks only by how much centroid ``j``'s move can bring it closer to *any* point of the sphere
around the old centroid of ``a`` with that cluster's largest ``u`` as radius. That amount is computed in the plane of
the sphere's centre and the old and new positions of ``j``: for a point ``x``,
``|x - c| - |x - c'| = 2 d.(x - m) / (|x - c| + |x - c'|)`` with ``d = c' - c`` and ``m`` the midpoint; over the sphere
the numerator is at most ``2 (d.(s - m) + R |d|)`` and the denominator at least
``max(|d|, |s - c| + |s - c'| - 2R)``. A sphere lying aside of a move loses far less than the drift ``|d|``. A vector
whose ``u`` stays below all its ``l[j]`` keeps its cluster without a distance; an ambiguous one is scanned exactly
against all centroids (integer squared distances, ties to the smaller number) and its bounds are reset.

Spark holds the vectors and their bounds; a round is one pass of Arrow batches over them, written to the checkpoint
folder, and one aggregate of integer sums per cluster (partial sums per task, so a cluster with a third of all rows
costs no more than any other). Only ``k`` centroids, radii and sums ever reach the driver. Distances are float only in
the bounds, with a margin; every decision that the bounds cannot make safely is taken on exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.checkpoints import checkpoint

#: Relative and absolute slack on float bounds, far above their rounding error.
_SLACK = 1e-9
#: Columns of the state between rounds; input columns of these names are dropped.
_OWN = ("_a", "_u", "_l", "_scans", "_distance")


def integer_vectors(embedding: Column, dims: int) -> Column:
    """floor(64 * x) of each component as longs, or NULL unless the vector has exactly ``dims`` finite components."""
    whole = (F.size(embedding) == dims) & (F.size(F.filter(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) == 0)
    return F.when(whole, F.transform(embedding, lambda x: F.floor(F.lit(64.0) * x.cast("double")).cast("long")))


def hash_seeds(vectors: DataFrame, key: str, vec: str, k: int, label: str = "1") -> list[list[int]]:
    """The vectors of the ``k`` keys with smallest lowercase sha256 of ``<label>:<key>``, in that order; ties by vector.

    Rows without a key never seed. Only ``k`` rows reach the driver (per-task top ``k``, then one merge).
    """
    hashed = vectors.where(F.col(key).isNotNull()).select(F.sha2(F.concat(F.lit(f"{label}:"), F.col(key).cast("string")), 256).alias("h"), F.col(vec).alias("v"))
    return [list(r["v"]) for r in hashed.orderBy("h", "v").limit(k).collect()]


def _tightened(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """t[a, j]: how much closer centroid j's move can bring any point of the sphere (old[a], radii[a]); at most its drift."""
    delta = new - old
    drift = np.linalg.norm(delta, axis=1)
    middle = (new + old) / 2
    centre = old[:, None, :]  # spheres along axis 0, moved centroids along axis 1
    radius = radii[:, None]
    numerator = 2 * (np.einsum("jd,ajd->aj", delta, centre - middle[None]) + radius * drift[None])
    apart = np.linalg.norm(centre - old[None], axis=2) + np.linalg.norm(centre - new[None], axis=2) - 2 * radius
    denominator = np.maximum(drift[None], apart)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(numerator > 0, numerator / denominator, 0.0)
    bound = np.minimum(np.nan_to_num(bound, nan=0.0, posinf=np.inf), drift[None])
    return bound * (1 + _SLACK) + _SLACK * (drift[None] > 0)


def _exact(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Integer squared distances of every row to every centroid."""
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _state_schema(kept: list[T.StructField]) -> T.StructType:
    return T.StructType(
        kept
        + [
            T.StructField("_a", T.IntegerType(), False),
            T.StructField("_u", T.DoubleType(), False),
            T.StructField("_l", T.ArrayType(T.DoubleType(), False), False),
            T.StructField("_scans", T.IntegerType(), False),
            T.StructField("_distance", T.LongType(), True),
        ]
    )


def _assign(state: DataFrame, vec: str, old: np.ndarray | None, new: np.ndarray, radii: np.ndarray | None, exact_distance: bool) -> DataFrame:
    """One assignment to ``new``; without ``old`` every vector is scanned, else bounds decide where they can."""
    kept = [f for f in state.schema.fields if f.name not in _OWN]
    schema = _state_schema(kept)
    names = [f.name for f in kept]
    k = len(new)
    tight = drift = None
    if old is not None:
        tight = _tightened(old.astype(float), new.astype(float), radii)
        drift = np.linalg.norm((new - old).astype(float), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            flat = batch.column(vec).flatten().to_numpy(zero_copy_only=False)
            v = flat.astype(np.int64).reshape(n, -1) if flat.size else np.zeros((n, new.shape[1]), np.int64)
            scans = batch.column("_scans").to_numpy(zero_copy_only=False).copy() if old is not None else np.zeros(n, np.int32)
            if old is None:
                ambiguous = np.ones(n, bool)
                a, u, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros((n, k))
            else:
                a = batch.column("_a").to_numpy(zero_copy_only=False).astype(np.int64)
                u = batch.column("_u").to_numpy(zero_copy_only=False) + drift[a]
                lower = batch.column("_l").flatten().to_numpy(zero_copy_only=False).reshape(n, k) - tight[a]
                rivals = lower.copy()
                rivals[np.arange(n), a] = np.inf
                ambiguous = u * (1 + _SLACK) + _SLACK >= rivals.min(axis=1)
            if ambiguous.any():
                d2 = _exact(v[ambiguous], new)
                a[ambiguous] = d2.argmin(axis=1)  # the first of equal minima: the smaller number
                root = np.sqrt(d2.astype(float))
                lower[ambiguous] = root
                u[ambiguous] = root[np.arange(len(root)), a[ambiguous]]
                scans[ambiguous] += 1
            distance = ((v - new[a]) ** 2).sum(axis=1) if exact_distance else None
            columns = [batch.column(c) for c in names] + [
                pa.array(a.astype(np.int32)),
                pa.array(u),
                pa.FixedSizeListArray.from_arrays(pa.array(lower.ravel()), k).cast(pa.list_(pa.field("element", pa.float64(), False))),
                pa.array(scans.astype(np.int32)),
                pa.array(distance, pa.int64()) if exact_distance else pa.nulls(n, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return state.mapInArrow(run, schema)


def _centroids(state: DataFrame, vec: str, current: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next centroids (exact floor of sum over count; empty clusters stay) and each cluster's largest ``u``."""
    dims = current.shape[1]
    sums = state.groupBy("_a").agg(F.count("*").alias("n"), F.max("_u").alias("r"), *(F.sum(F.col(vec)[i]).alias(f"s{i}") for i in range(dims)))
    moved, radii = current.copy(), np.zeros(len(current))
    for row in sums.collect():  # at most k rows
        a, n = row["_a"], row["n"]
        moved[a] = [row[f"s{i}"] // n for i in range(dims)]
        radii[a] = row["r"]
    return moved, radii


def drift_kmeans(vectors: DataFrame, vec: str, seeds: list[list[int]], rounds: int = 3) -> tuple[DataFrame, np.ndarray]:
    """Cluster ``vectors`` (column ``vec``: equal-length integer arrays, no NULL) from ``seeds``.

    ``rounds`` times: assign every vector to its nearest centroid, then move every non-empty centroid to the floor of its
    members' mean; then assign once more. Returns the rows with ``cluster`` (int), ``distance`` (long, squared) and
    ``scans`` (assignments that scanned all centroids, of ``rounds + 1``), and the final centroids. Other columns pass
    through; columns named ``cluster``, ``distance``, ``scans`` or like the state's (``_a``, ``_u``, ``_l``, ``_scans``,
    ``_distance``) are replaced. An empty table gives an empty result;
    no seeds give no centroids and an error.
    """
    if not seeds:
        raise ValueError("no seeds")
    centroids = np.array(seeds, np.int64)
    start = vectors.drop("cluster", "distance", "scans", *_OWN).select("*", F.lit(0).alias("_scans"))
    state = checkpoint(_assign(start, vec, None, centroids, None, rounds == 0))
    for r in range(rounds):
        moved, radii = _centroids(state, vec, centroids)
        state = checkpoint(_assign(state, vec, centroids, moved, radii, r == rounds - 1))
        centroids = moved
    result = state.select(
        *[c for c in state.columns if c not in _OWN],
        F.col("_a").alias("cluster"),
        F.col("_distance").alias("distance"),
        F.col("_scans").alias("scans"),
    )
    return result, centroids


def cluster_report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` (of the final centroid as decimal
    integers joined by commas). The per-cluster table has at most ``k`` rows and is broadcast."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    table = spark.createDataFrame(
        [(a, int(sums.get(a, 0)), int(total), ",".join(str(int(x)) for x in c)) for a, c in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid string",
    ).select("cluster", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))
    return assigned.drop("cluster_inertia", "inertia", "centroid_sha256").join(F.broadcast(table), "cluster")
