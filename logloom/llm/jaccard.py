"""Jaccard join on word shingles with prefix, length, positional and suffix filters, up to connected components.

Shingles are 56-bit hashes. A shingle's key is its document frequency (8 bits) before its hash, so ascending keys are
rare first. Texts with equal sets are one node.

1. Tasks make the sets and send sorted, packed blocks of shingles to buckets by hash; a bucket adds up document
   frequencies and answers each block with the shingles that another set has, too. A shingle that is common within a block goes as a count,
   so no bucket gets a row per document of a very common shingle. Shingles of one set only come first in the
   order and never match, so their number is all that is needed of them.
2. Nodes whose prefix reaches beyond those are posted under their prefix shingles. In each list all nodes are paired with
   one pivot, the one with the fewest shingles of its own; verified pairs make components.
3. In lists with several components left, nodes outside the largest are paired with all nodes of other components. So
   every pair that shares a prefix shingle is verified once or lies in one component already: no link between components is lost.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.checkpoints import materialize
from logloom.llm import texts
from logloom.llm.components import components
from logloom.llm.shingles import mix, shingle_sets
from logloom.workers import ship_package

_HASH_BITS = 56
#: A shingle in this many sets of a block is sent as a count.
_COMMON = 8
_BLOCK = "kind int, bucket long, part long, payload binary"


def least_overlap(na, nb, percent: int):
    """The smallest intersection with 100 * i >= percent * (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix_length(n, percent: int):
    """So many rarest shingles must share one with a similar set."""
    return n - -(-percent * n // 100) + 1


def _pack(**arrays) -> bytes:
    """Arrays of whole numbers, transposed by byte so that high bytes compress."""
    parts = [np.array([len(arrays), *(x for a in arrays.values() for x in (len(a), a.dtype.itemsize))], np.int32).tobytes()]
    parts += [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays.values()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    k = int(np.frombuffer(raw, np.int32, 1)[0])
    shape = np.frombuffer(raw, np.int32, 2 * k, 4).reshape(k, 2)
    at, out = 4 + 8 * k, []
    for n, width in shape.tolist():
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"u{width}").reshape(-1))
        at += n * width
    return out


def _deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def _runs(counts: np.ndarray) -> np.ndarray:
    """Positions of the first of ``counts`` consecutive rows each."""
    return np.cumsum(counts) - counts


def _sliced(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + count)."""
    return np.repeat(starts - _runs(counts), counts) + np.arange(int(counts.sum()))


def _blocks(width: int, buckets: int, block_shingles: int):
    """Packed blocks of a task's documents: one row with the documents, one for each bucket with its shingles."""

    def flush(number, ids, sets):
        part = (TaskContext.get().partitionId() << 24) + number
        sizes = np.array([len(s) for s in sets], np.int64)
        prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        known = [i is not None for i in ids]
        order = sorted(range(len(ids)), key=lambda i: (prints[i], not known[i], ids[i] if known[i] else 0))
        leads = [i for j, i in enumerate(order) if len(sets[i]) and (j == 0 or prints[order[j - 1]] != prints[i])]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in leads)]) >> np.uint64(64 - _HASH_BITS)
        owners = np.repeat(np.array(leads, np.uint32), sizes[np.array(leads, np.int64)])
        by_hash = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[by_hash], owners[by_hash]
        kinds, firsts, counts = np.unique(hashes, return_index=True, return_counts=True)
        common = counts >= _COMMON
        where = _sliced(firsts[common], counts[common])
        table = _pack(
            ids=np.array([i if k else 0 for i, k in zip(ids, known)], np.int64),
            known=np.array(known, np.uint8),
            sizes=sizes,
            prints=np.frombuffer(b"".join(prints), np.uint64),
            leads=np.array(leads, np.uint32),
            common=kinds[common],
            counts=counts[common],
            owners=owners[where],
        )
        # By a hash: part numbers of different tasks are equal modulo any power of two.
        rows = [(0, int(mix(np.array([part], np.uint64))[0] % np.uint64(buckets)), part, table)]
        ends = np.searchsorted(kinds, np.array([(b << _HASH_BITS) // buckets for b in range(1, buckets + 1)], np.uint64))
        begin = 0
        for bucket, end in enumerate(ends.tolist()):
            if end > begin:
                some = slice(begin, end)
                cold = ~common[some]
                at = _sliced(firsts[some][cold], counts[some][cold])
                rows.append((1, bucket, part, _pack(h=_deltas(kinds[some]), n=counts[some].astype(np.uint32), owners=owners[at])))
            begin = end
        kind, bucket, parts, payload = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), pa.array(parts, pa.int64()), pa.array(payload, pa.binary())],
            names=["kind", "bucket", "part", "payload"],
        )

    def run(batches):
        number, ids, sets, held = 0, [], [], 0
        for batch in texts.slices(batches, "text", 1 << 20):
            found = shingle_sets(texts.texts_of(batch, "text"), width)
            ids += batch.column("doc_id").to_pylist()
            sets += found
            held += sum(map(len, found)) + 16 * len(found)
            if held >= block_shingles:
                yield flush(number, ids, sets)
                number, ids, sets, held = number + 1, [], [], 0
        if ids:
            yield flush(number, ids, sets)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Answers of one bucket: to each part, its shingles that some other set has, with document frequencies."""
    kinds = table.column("kind").to_pylist()
    payloads, parts = table.column("payload"), table.column("part").to_pylist()
    rows = [(k, p, payloads[i].as_py()) for i, (k, p) in enumerate(zip(kinds, parts)) if k == 0]
    asked = [i for i, k in enumerate(kinds) if k == 1]
    blocks = [_unpack(payloads[i].as_py()) for i in asked]
    if blocks:
        hashes = [np.cumsum(h, dtype=np.uint64) for h, _, _ in blocks]
        flat, n = np.concatenate(hashes), np.concatenate([b[1] for b in blocks]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
        total = np.add.reduceat(n[order], first)
        df = np.empty(len(flat), np.int64)
        df[order] = np.repeat(total, np.diff(np.append(first, len(flat))))
        at = 0
        for i, h, (_, counts, owners) in zip(asked, hashes, blocks):
            mine = df[at : at + len(h)]
            at += len(h)
            shared = mine >= 2
            counts = counts.astype(np.int64)
            cold = np.where(counts < _COMMON, counts, 0)
            picked = _sliced(_runs(cold)[shared], cold[shared])
            rows.append(
                (1, parts[i], _pack(h=_deltas(h[shared]), n=counts[shared].astype(np.uint32), df=mine[shared].astype(np.uint64), owners=owners[picked]))
            )
    kind, part, payload = zip(*rows)
    return pa.table({"kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int64()), "payload": pa.array(payload, pa.binary())})


def _gather(percent: int):
    """One part's documents with the keys that they share."""

    def frequency_class(df):
        """Exact to 128, then by eighth powers of two."""
        return np.where(df <= 128, df, np.minimum(128 + 8 * np.log2(np.maximum(df, 128) / 128), 255)).astype(np.uint64)

    def run(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("kind").to_pylist(), table.column("payload")
        ids, known, sizes, prints, leads, common, counts, owners = _unpack(payloads[kinds.index(0)].as_py())
        sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
        common_at = _runs(counts)
        keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for i, kind in enumerate(kinds):
            if kind != 1:
                continue
            h, n, df, cold_owners = _unpack(payloads[i].as_py())
            n, key = n.astype(np.int64), np.cumsum(h, dtype=np.uint64)
            hot = n >= _COMMON
            place = np.searchsorted(common, key[hot])
            key = key | frequency_class(df) << np.uint64(_HASH_BITS)
            keys += [np.repeat(key[~hot], n[~hot]), np.repeat(key[hot], n[hot])]
            docs += [cold_owners, owners[_sliced(common_at[place], n[hot])]]
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((keys, docs))
        keys, docs = keys[order], docs[order]
        stops = np.searchsorted(docs, np.arange(len(ids) + 1, dtype=np.uint32))
        shared = np.diff(stops)
        own = sizes - shared
        is_lead = np.zeros(len(ids), bool)
        is_lead[leads.astype(np.int64)] = True
        open_ = is_lead & (own < prefix_length(sizes, percent)) & (sizes > 0)
        prints = prints.tobytes()
        return pa.table(
            {
                "doc_id": pa.array(ids.view(np.int64), pa.int64(), mask=known == 0),
                "n": pa.array(sizes, pa.int64()),
                "node": pa.array([prints[16 * i : 16 * i + 16] for i in range(len(ids))], pa.binary()),
                "own": pa.array(own, pa.int64()),
                "keys": pa.array([keys[stops[i] : stops[i + 1]].tobytes() if o else None for i, o in enumerate(open_)], pa.binary()),
            }
        )

    return run


def _suffix_distance(a: np.ndarray, b: np.ndarray, most: int, depth: int = 3) -> int:
    """A lower bound of the number of keys in one of two ascending arrays only, by splitting at a middle key."""
    gap = abs(len(a) - len(b))
    if gap > most or not depth or not len(a) or not len(b):
        return gap
    middle = len(b) // 2
    at = int(np.searchsorted(a, b[middle]))
    same = int(at < len(a) and a[at] == b[middle])
    right = abs((len(a) - at - same) - (len(b) - middle - 1)) + (1 - same)
    left = _suffix_distance(a[:at], b[:middle], most - right, depth - 1)
    if left + right > most:
        return left + right
    return left + (1 - same) + _suffix_distance(a[at + same :], b[middle + 1 :], most - left - (1 - same), depth - 1)


def overlap_if_similar(a: np.ndarray, b: np.ndarray, na: int, nb: int, percent: int) -> int | None:
    """The intersection of two sets, of which ``a`` and ``b`` are the ascending shared keys; None if too small."""
    least = least_overlap(na, nb, percent)
    if min(len(a), len(b)) < least:
        return None
    if _suffix_distance(a, b, len(a) + len(b) - 2 * least) > len(a) + len(b) - 2 * least:
        return None
    place = np.searchsorted(a, b)
    place[place == len(a)] = 0
    overlap = int(np.count_nonzero(a[place] == b)) if len(a) else 0
    return overlap if overlap >= least else None


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar."""

    def run(batches):
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                a, b, na, ka, nb, kb = row
                if overlap_if_similar(np.frombuffer(ka, np.uint64), np.frombuffer(kb, np.uint64), na, nb, percent) is not None:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    def side(name):
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("keys").alias(f"k{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "ka", "nb", "kb")
    return materialize(both.mapInArrow(run, "a binary, b binary"), "jaccard-links")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length and positional filters on two postings of one shingle."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    least = F.ceil(percent * (nx + ny) / (100.0 + percent) - 1e-9)
    left = F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos"))
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (left >= least)


def shingle_table(docs: DataFrame, width: int, percent: int, id_column: str, text_column: str, block_shingles: int = 1 << 20) -> DataFrame:
    """``doc_id, n, node, own, keys`` of each document: set size, hash of the set, shingles of this set only, and, where the prefix goes beyond those, the ascending keys of the others."""
    spark = docs.sparkSession
    ship_package(spark)
    buckets = 4 * texts.partitions(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    blocks = rows.mapInArrow(_blocks(width, buckets, block_shingles), _BLOCK)
    answers = blocks.groupBy("bucket").applyInArrow(_answer, "kind int, part long, payload binary")
    sets = answers.groupBy("part").applyInArrow(_gather(percent), "doc_id long, n long, node binary, own long, keys binary")
    return materialize(sets, "shingle-sets")


def similarity_components(
    docs: DataFrame, width: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per document.

    Two documents link when 100 * intersection >= percent * union of their shingle sets; the component is the smallest
    id reachable by links. A-Z count as a-z. Texts of fewer words than ``width`` have one shingle, all words; null, empty
    and blank texts have none and link with nothing. Repeated rows link with each other. Null ids come out as null and
    do not name a component unless all its ids are null. An empty table gives no rows; extra columns are not read.
    """
    sets = shingle_table(docs, width, percent, id_column, text_column)
    nodes = materialize(sets.where(F.col("keys").isNotNull()).select("node", "n", "own", "keys").dropDuplicates(["node"]), "jaccard-nodes")

    def post(batches):
        for batch in batches:
            sizes, own = batch.column("n").to_pylist(), batch.column("own").to_pylist()
            heads = [np.frombuffer(k, np.uint64)[: prefix_length(n, percent) - o] for k, n, o in zip(batch.column("keys").to_pylist(), sizes, own)]
            counts = np.array([len(h) for h in heads], np.int64)
            row = np.repeat(np.arange(len(heads)), counts)
            position = np.arange(int(counts.sum())) - _runs(counts)[row] + np.array(own, np.int64)[row]
            keys = np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column("node").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array(position, pa.int64())],
                names=["key", "node", "n", "pos"],
            )

    postings = materialize(nodes.mapInArrow(post, "key long, node binary, n long, pos long"), "jaccard-postings")
    # Few shingles of its own: the text that copies come from.
    rank = F.struct((F.col("pos") / F.col("n")).alias("rank"), "node", "n", "pos")
    lists = postings.groupBy("key").agg(F.min(rank).alias("pivot"), F.count("*").alias("nodes")).where("nodes > 1")
    pivots = materialize(lists.select("key", "pivot.node", "pivot.n", "pivot.pos"), "jaccard-pivots")
    starred = postings.alias("x").join(pivots.alias("y"), "key").where((F.col("x.node") != F.col("y.node")) & _may_link("x", "y", percent))
    ordered = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    tried = materialize(starred.select(*ordered).distinct(), "jaccard-pairs")
    links = _verified(tried, nodes, percent)
    grouped = components(links)
    placed = materialize(
        postings.join(pivots.select("key"), "key").join(grouped, "node", "left").select("key", "node", "n", "pos", F.coalesce("component", "node").alias("component")),
        "jaccard-postings",
    )
    per_list = placed.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component")).alias("top"), F.count("*").alias("kinds"))
    mixed = materialize(per_list.where("kinds > 1").select("key", F.col("top.component").alias("largest")), "jaccard-mixed")
    open_lists = materialize(placed.join(mixed, "key"), "jaccard-open")
    outside = open_lists.where(F.col("component") != F.col("largest"))
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))
    crossing = outside.alias("x").join(open_lists.alias("y"), "key").where(
        (F.col("x.component") != F.col("y.component")) & once & _may_link("x", "y", percent)
    )
    more = materialize(crossing.select(*ordered).distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    grouped = components(links.unionByName(_verified(more, nodes, percent)))
    classes = materialize(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("smallest")), "jaccard-classes")
    joined = materialize(classes.join(grouped, "node", "left").select("node", "smallest", F.coalesce("component", "node").alias("component")), "jaccard-classes")
    smallest = materialize(joined.groupBy("component").agg(F.min("smallest").alias("component_id")), "jaccard-components")
    named = materialize(joined.select("node", "component").join(smallest, "component").select("node", "component_id"), "jaccard-names")
    linked = sets.where("n > 0").select("doc_id", "n", "node").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
