"""Best-fit decreasing packing of token pieces into sequences, over all documents at once.

Best-fit decreasing only looks at lengths. So the tasks count pieces by length, the driver works out the packing of the
at most ``capacity`` counts with a segment tree over remaining capacities (the tightest open bin in logarithmic time for
each run of equal pieces), and the tasks look up each piece's place by its rank among the pieces of its length. Runs and
open bins are intervals, so the plan's size depends on ``capacity`` alone and not on the number of documents. The
result is that of one packer fed all pieces, longest first.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.checkpoints import materialize
from logloom.llm import texts, tokens
from logloom.workers import ship_package


class CapacityTree:
    """Segment tree over capacities 0..size: which of them an open bin has."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, value: bool) -> None:
        i = self.leaves + capacity
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least``."""
        i = self.leaves + least
        if self.any[i]:
            return i - self.leaves
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan_best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces per bin, offset in the bin), by length and rank.

    Pieces of equal length are placed in runs: while the tightest bin of remaining capacity r fits k of them, best fit
    puts k into it before it turns to another bin, and all bins of capacity r are alike.
    """
    tree, open_bins = CapacityTree(capacity), {}
    rows, bins = [], 0

    def push(rest, first, n):
        if n and rest:
            open_bins.setdefault(rest, []).append((first, n))
            tree.set(rest, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            rest = tree.tightest(length)
            if rest is None:
                rest, first, n = capacity, bins, max(1, left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[rest].pop()
                if not open_bins[rest]:
                    tree.set(rest, False)
            per = rest // length
            used, put = left // per, per
            if used == 0:  # the last pieces leave room in one bin
                used, put = 1, left
            used = min(used, n)
            rows.append((length, rank, first, per, capacity - rest))
            push(rest - length * put, first, used)
            push(rest, first + used, n - used)
            left, rank = left - used * put, rank + used * put
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces; only longer documents are cut, and only a first piece is short."""
    n = -(-lengths // capacity)
    first = lengths - (n - 1) * capacity
    doc = np.repeat(np.arange(len(lengths)), n)
    piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first[doc], capacity)


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_column: str, text_column: str, special_tokens: bool = False
) -> DataFrame:
    """One row per piece, with its task and its rank among the task's pieces of that length; written once."""
    ship_package(docs.sparkSession)

    def pieces(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        encode = tokens.encoder(tokenizer, special_tokens).encode
        for batch in texts.slices(batches, "text", 1 << 20):
            ids, n = tokens.ended(*encode(texts.texts_of(batch, "text")), end_id)
            doc, piece, start, length = cut(n, capacity)
            begin = (np.cumsum(n) - n)[doc] + start
            order = np.argsort(length, kind="stable")
            kinds, firsts, sizes = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(firsts - seen[kinds], sizes)
            seen[kinds] += sizes
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(ids[a : a + k]) for a, k in zip(begin, length)], pa.int64()),
                    pa.array(np.full(len(doc), part), pa.int32()),
                    pa.array(rank, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"],
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"
    return materialize(rows.mapInArrow(pieces, schema), "token-pieces")


def best_fit_pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    special_tokens: bool = False,
) -> DataFrame:
    """Place every document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and ``end_id``; null text is empty, so it is one piece of length 1. Longer documents than
    ``capacity`` are cut into pieces of ``capacity``, the first of which may be shorter. Sequences are numbered from 0,
    and pieces lie in them without gaps. Null or repeated ids are rows like others; repeated rows get places of their
    own. An empty table gives no rows. Extra columns are not read. Strings of added tokens are ordinary text, or with
    ``special_tokens`` the token's id, the library's default.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_column, text_column, special_tokens)
    by_part = pieces.groupBy("part", "length").count()
    # At most one row per length and task; a window holds one row per task.
    before = Window.partitionBy("length").orderBy("part")
    bases = by_part.select("part", "length", (F.sum("count").over(before) - F.col("count")).alias("base"))
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_best_fit(counts, capacity)
    keys = (plan[:, 0] << 48) + plan[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            placed = [pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)]
            columns = [*batch.columns[:-1], *placed]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank_in_part") + F.col("base")).alias("rank")
    )
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
