"""Exact top-k inner products by dual-tree search over cover trees.

The top level of the index is a bounded set of pivots: every vector goes to the cell of its nearest pivot, a cell is
dealt into blocks of about ``block_rows`` vectors, and each block is a cover tree. Queries are grouped the same way, with
a cover tree for each group. A group first searches the block where it expects its best scores; then only cells, and in
them only pairs of query and data nodes, whose bound

    <q, p> + Rq |p| + Rp |q| + Rq Rp      (centres q, p; covering radii Rq, Rp)

reaches the worst k-th score of the query group so far are opened. Bounds are compared with ties kept, so results are exact.
"""

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.checkpoints import materialize
from logloom.llm import texts
from logloom.workers import ship_package


class CoverTree:
    """Nodes cover their points within ``radius``; children are centres more than ``radius / base`` apart, the first of
    them the node's own, so scales shrink by ``base`` from level to level. A node of at most ``leaf_size`` points is a leaf,
    and so is one that would fall apart into children of less than an eighth of that on average: among points that lie equally far
    from each other no split prunes, and one matrix product is faster."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf_size: int = 256, base: float = 1.3):
        order, nodes = [], []  # node: [centre, radius, begin, end, children]
        squares = np.einsum("ij,ij->i", points, points)

        def distances(members, centre):
            d2 = squares[members] + squares[centre] - 2 * (points[members] @ points[centre])
            return np.sqrt(np.maximum(d2, 0))

        def add(members, centre, d):
            """The number of the new node over ``members`` at distances ``d``; its points become a range of ``order``."""
            number, radius, begin = len(nodes), float(d.max()), len(order)
            nodes.append([centre, radius, begin, 0, []])
            near, owner, centres = d.copy(), np.zeros(len(members), np.int64), [centre]
            split = len(members) > leaf_size and radius > 1e-9
            while split and near.max() > radius / base:
                pick = int(near.argmax())
                centres.append(int(members[pick]))
                d_new = distances(members, members[pick])
                d_new[pick] = 0
                closer = d_new < near
                owner[closer], near[closer] = len(centres) - 1, d_new[closer]
                split = len(centres) * leaf_size <= 8 * len(members)
            if split:
                for k, c in enumerate(centres):
                    mine = owner == k
                    if mine.any():
                        nodes[number][4].append(add(members[mine], c, near[mine]))
            else:
                order.extend(members.tolist())
            nodes[number][3] = len(order)
            return number

        everyone = np.arange(len(points))
        first = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
        add(everyone, first, distances(everyone, first))
        centres = np.array([n[0] for n in nodes])
        self.centre, self.norm = points[centres], np.sqrt(squares[centres])
        # Rounding of distances must not narrow a ball.
        self.radius = np.array([n[1] for n in nodes]) * (1 + 1e-7) + 1e-4
        self.begin, self.end = np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])
        self.children = [np.array(n[4], np.int64) for n in nodes]
        order = np.array(order, np.int64)
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]

    def pack(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(self.__dict__, protocol=5))

    @classmethod
    def unpack(cls, data: bytes) -> "CoverTree":
        tree = cls.__new__(cls)
        tree.__dict__ = pickle.loads(zstandard.decompress(data))
        return tree


class Best:
    """The k best (score, id, row) of each query, by score, then smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.rows = np.full((n, k), -1)

    @property
    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, at: slice, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores (queries x points) of the queries in ``at``."""
        top = score.max(axis=1)
        useful = np.flatnonzero((top >= self.kth[at]) & (top > -np.inf))
        if not len(useful):
            return
        score, mine = score[useful], useful + at.start
        least = self.kth[mine]
        if score.shape[1] > self.k:
            least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
        query, point = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        before = np.repeat(np.arange(len(mine)), self.k)
        query_all = np.concatenate([before, query])
        score_all = np.concatenate([self.score[mine].ravel(), score[query, point]])
        ids_all = np.concatenate([self.ids[mine].ravel(), ids[point]])
        rows_all = np.concatenate([self.rows[mine].ravel(), rows[point]])
        order = np.lexsort((rows_all, ids_all, -score_all, query_all))
        starts = np.searchsorted(query_all[order], np.arange(len(mine)))
        best = order[starts[:, None] + np.arange(self.k)]
        self.score[mine], self.ids[mine], self.rows[mine] = score_all[best], ids_all[best], rows_all[best]


def _bounds(queries: CoverTree, q: int, data: CoverTree, nodes: np.ndarray) -> np.ndarray:
    rq, rp = queries.radius[q], data.radius[nodes]
    top = data.centre[nodes] @ queries.centre[q] + rq * data.norm[nodes] + rp * queries.norm[q] + rq * rp
    return top + 1e-9 * np.abs(top)


def dual_search(queries: CoverTree, data: CoverTree, best: Best) -> None:
    """Bring ``best`` (in the order of ``queries.points``) up to date with all points of ``data``."""
    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        q, frontier = stack.pop()
        at = slice(queries.begin[q], queries.end[q])
        bounds = _bounds(queries, q, data, frontier)
        keep = bounds >= best.kth[at].min()
        frontier, bounds = frontier[keep], bounds[keep]
        if not len(frontier):
            continue
        if len(queries.children[q]):
            opened = [data.children[p] if len(data.children[p]) else np.array([p]) for p in frontier]
            following = np.concatenate(opened)
            stack += [(int(child), following) for child in queries.children[q]]
            continue
        heap = list(zip((-bounds).tolist(), frontier.tolist()))
        heapq.heapify(heap)
        while heap and -heap[0][0] >= best.kth[at].min():
            _, p = heapq.heappop(heap)
            children = data.children[p]
            if len(children):
                found = _bounds(queries, q, data, children)
                worst = best.kth[at].min()
                for b, child in zip(found.tolist(), children.tolist()):
                    if b >= worst:
                        heapq.heappush(heap, (-b, child))
                continue
            points = slice(data.begin[p], data.end[p])
            if data.radius[p] <= 1e-3 and data.end[p] - data.begin[p] > best.k + 1:
                # Copies of one vector: the smallest ids, and one more as a query may be among them.
                points = data.begin[p] + np.lexsort((data.rows[points], data.ids[points]))[: best.k + 1]
            score = queries.points[at] @ data.points[points].T
            rows = data.rows[points]
            score[queries.rows[at][:, None] == rows[None, :]] = -np.inf
            best.offer(at, score, data.ids[points], rows)


def _tree_of(frame: pd.DataFrame, leaf_size: int) -> CoverTree:
    frame = frame.sort_values("row")
    points = np.stack([np.asarray(v, np.float64) for v in frame["v"]])
    return CoverTree(points, frame["vec_id"].to_numpy(np.int64), frame["row"].to_numpy(np.int64), leaf_size)


def integer_vectors(table: DataFrame, vector: str = "embedding", scale: int = 64) -> Column:
    """floor(scale * x) of each component as doubles; null where the vector or a component is null or not finite."""
    x = F.transform(vector, lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(F.col(vector).isNotNull() & whole, F.transform(x, lambda c: F.floor(c * scale).cast("double")))


def top_k_products(
    vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 32, block_rows: int = 4096, group_rows: int = 256, leaf_size: int = 256
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query row with all rows but itself.

    ``vectors`` has ``vec_id`` and ``v`` (whole numbers as doubles). Rows with a null vector take no part, a query
    meets vectors of its own length only, repeated rows are rows of their own, and ties go to the smaller id. Scores are
    exact up to 2^53. At most ``pivots`` vectors of each length, those with the smallest hashes, come to the driver as the
    index's top level; all vectors are indexed. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = materialize(
        vectors.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "v", is_query.alias("query"), F.size("v").alias("dim")
        ),
        "vectors",
    )
    chosen = Window.partitionBy("dim").orderBy(F.xxhash64("v"), "row")
    tops = rows.withColumn("n", F.row_number().over(chosen)).where(F.col("n") <= pivots).select("dim", "v").collect()
    by_dim: dict[int, np.ndarray] = {}
    for dim in sorted({r["dim"] for r in tops}):
        own = [r["v"] for r in tops if r["dim"] == dim]
        by_dim[dim] = np.unique(np.array(own, np.float64).reshape(len(own), dim), axis=0) if dim else np.zeros((1, 0))
    first_cell = dict(zip(by_dim, np.cumsum([0, *map(len, by_dim.values())])))
    centres = [c for points in by_dim.values() for c in points]

    def assign(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, gap = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            values = batch.column("v").to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x, p = np.array([values[i] for i in at], np.float64).reshape(len(at), dim), by_dim[int(dim)]
                near = ((p * p).sum(axis=1)[None] - 2 * x @ p.T).argmin(axis=1)
                cell[at] = first_cell[int(dim)] + near
                gap[at] = np.sqrt(((x - p[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("row", "vec_id", "v", "query")), pa.array(cell), pa.array(gap)],
                names=["row", "vec_id", "v", "query", "cell", "gap"],
            )

    schema = "row long, vec_id long, v array<double>, query boolean, cell int, gap double"
    placed = materialize(rows.mapInArrow(assign, schema), "vector-cells")
    # One row per cell.
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("query").alias("asks"), F.max("gap").alias("radius")).collect()}
    blocks = {c: -(-r["n"] // block_rows) for c, r in cells.items()}
    groups = {c: -(-r["asks"] // group_rows) for c, r in cells.items()}

    def dealt(by: dict[int, int]) -> Column:
        if not by:
            return F.lit(0).cast("long")
        parts = F.create_map(*(F.lit(x) for c, n in sorted(by.items()) for x in (c, max(n, 1))))
        return F.pmod(F.xxhash64("row"), parts[F.col("cell")].cast("long"))

    def trees(of: DataFrame, by: dict[int, int], leaf_size: int, name: str) -> DataFrame:
        def plant(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"cell": frame["cell"].iloc[:1], "chunk": frame["chunk"].iloc[:1], "tree": [_tree_of(frame, leaf_size).pack()]})

        keyed = of.select("row", "vec_id", "v", "cell", dealt(by).alias("chunk"))
        return materialize(keyed.groupBy("cell", "chunk").applyInPandas(plant, "cell int, chunk long, tree binary"), name)

    data = trees(placed, blocks, leaf_size, "cover-trees").withColumnRenamed("tree", "data")
    asked = trees(placed.where("query"), groups, leaf_size // 4, "query-trees").withColumnsRenamed({"cell": "group_cell", "chunk": "group_chunk", "tree": "queries"})
    dims = np.array([len(c) for c in centres])

    def seeds(frames):
        """The cell whose pivot has the largest product with the group's centre; its first block."""
        for frame in frames:
            target = []
            for packed in frame["queries"]:
                centre = CoverTree.unpack(packed).centre[0]
                alike = [c for c in cells if dims[c] == len(centre)]
                target.append(max(alike, key=lambda c: (float(centres[c] @ centre), -c)))
            yield frame.assign(cell=np.array(target, np.int32), chunk=np.zeros(len(frame), np.int64))

    def first_search(frames):
        for frame in frames:
            states = []
            for packed, block in zip(frame["queries"], frame["data"]):
                queries = CoverTree.unpack(packed)
                best = Best(len(queries.rows), k)
                dual_search(queries, CoverTree.unpack(block), best)
                states.append(pickle.dumps(best, protocol=5))
            yield frame.drop(columns="data").assign(best=states)

    group = "group_cell int, group_chunk long, queries binary"
    seeded = asked.mapInPandas(seeds, group + ", cell int, chunk long").join(data, ["cell", "chunk"])
    ordered = seeded.select("group_cell", "group_chunk", "queries", "cell", "chunk", "data")
    started = materialize(ordered.mapInPandas(first_search, group + ", cell int, chunk long, best binary"), "first-search")

    def targets(frames):
        """All blocks of the cells that can reach the group's worst k-th score, but for the block searched."""
        for frame in frames:
            out = []
            for i, (packed, state) in enumerate(zip(frame["queries"], frame["best"])):
                queries, worst = CoverTree.unpack(packed), pickle.loads(state).kth.min()
                q, rq, nq = queries.centre[0], queries.radius[0], queries.norm[0]
                done = frame["cell"].iloc[i], frame["chunk"].iloc[i]
                for c, r in cells.items():
                    if dims[c] != len(q):
                        continue
                    radius = r["radius"] * (1 + 1e-7) + 1e-4
                    top = centres[c] @ q + rq * np.linalg.norm(centres[c]) + radius * nq + rq * radius
                    if top * (1 + 1e-9 * np.sign(top)) >= worst:
                        out += [(i, c, j) for j in range(blocks[c]) if (c, j) != done]
            picked = pd.DataFrame(out, columns=["i", "cell", "chunk"]).astype({"cell": np.int32, "chunk": np.int64, "i": np.int64})
            both = frame[["group_cell", "group_chunk"]].iloc[picked["i"].to_numpy()].reset_index(drop=True)
            yield both.assign(cell=picked["cell"], chunk=picked["chunk"])

    def result(queries: CoverTree, best: Best) -> pd.DataFrame:
        hit = (best.rows >= 0) & (best.score > -np.inf)
        at = np.nonzero(hit)[0]
        return pd.DataFrame(
            {"query_row": queries.rows[at], "query_id": queries.ids[at], "vec_id": best.ids[hit], "row": best.rows[hit], "score": best.score[hit].astype(np.int64)}
        )

    def search(frames):
        for frame in frames:
            for packed, state, block in zip(frame["queries"], frame["best"], frame["data"]):
                queries, known = CoverTree.unpack(packed), pickle.loads(state)
                # Placeholders hold the k-th scores, so that only what may still enter comes out.
                best = Best(len(queries.rows), k)
                best.score[:] = known.kth[:, None]
                dual_search(queries, CoverTree.unpack(block), best)
                yield result(queries, best)

    def kept(frames):
        for frame in frames:
            for packed, state in zip(frame["queries"], frame["best"]):
                yield result(CoverTree.unpack(packed), pickle.loads(state))

    found = "query_row long, query_id long, vec_id long, row long, score long"
    pairs = started.select("group_cell", "group_chunk", "queries", "cell", "chunk", "best").mapInPandas(
        targets, "group_cell int, group_chunk long, cell int, chunk long"
    )
    spread = materialize(pairs, "search-pairs").repartition(texts.partitions(spark), "cell", "chunk", "group_cell", "group_chunk")
    work = spread.join(started.select("group_cell", "group_chunk", "queries", "best"), ["group_cell", "group_chunk"]).join(data, ["cell", "chunk"])
    hits = work.select("queries", "best", "data").mapInPandas(search, found)
    everything = hits.unionByName(started.select("queries", "best").mapInPandas(kept, found))
    best_first = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = everything.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
