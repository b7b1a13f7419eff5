"""Sequential folds over ordered keys that never put one key into one task.

Some operators decide on a row by what they decided on earlier rows of the same key (a throttle, a bounded
duplicate filter), so no window frame expresses them. The rows, cut down to the columns the decision needs,
are range-partitioned by key and order: Spark samples the range, so a key with a third of all rows is spread
over a third of the tasks. The result is checkpointed, which fixes what each chunk holds. Then:

1. Each chunk reports its first and last key, which shows the keys that cross a chunk boundary.
2. Those keys' rows at the end of a chunk are folded to the state they hand to the next chunk.
3. A chunk that lies inside one key hands on a state that depends on the one it received. It is folded again
   when that changes, until nothing does. States usually forget: most settle in one or two rounds. If they do
   not, rounds follow that fold only the chunks whose incoming state is final, one per crossing key. States that
   are a single time skip this: see :mod:`logloom.operators.handover`. So do states that merge.
4. Every chunk is folded from its final incoming state and emits the decisions.

A task streams through Arrow batches and keeps one state, so memory does not grow with the chunk. The driver
sees two keys and one bounded state per chunk, never rows.
"""

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.checkpoints import checkpoint
from logloom.operators.handover import Handover, chunk_steps, hand_through
from logloom.workers import ship_package

KEY = "_key"
CHUNK = "_chunk"
# Decisions gathered before they are handed on.
_OUTPUT_ROWS = 10_000
# Rounds in which all stale chunks are folded at once, before folding only those certain to become final.
SPECULATIVE_ROUNDS = 4


Columns = dict[str, np.ndarray]


class Fold:
    """A left fold over the rows of one key, fed slice by slice as arrays by column name.

    A state must be small, picklable and comparable with ``==``; None is the state before the first row.
    """

    def step(self, state: Any, rows: Columns) -> tuple[Any, Columns | None]:
        """Advance over ``rows``; return the new state and the decisions that became final."""
        raise NotImplementedError

    def finish(self, state: Any) -> Columns | None:
        """Decisions left over when the key ends."""
        return None

    #: ``merge(entry, own)``: the state after a chunk, from the one it receives and the one it would reach from nothing.
    merge: Callable[[Any, Any], Any] | None = None

    def handover(self) -> Handover | None:
        """How a state of a single time passes through a chunk, if the fold has such states."""
        return None


@dataclass
class _Chunk:
    index: int
    first: Any
    last: Any
    latest: int | None = None
    exit: bytes | None = None

    @property
    def single(self) -> bool:
        return self.first == self.last


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Any, Columns]]:
    """The stretches of one chunk and key in each batch. There may be very many, so they are views of arrays."""
    for pdf in batches:
        if not len(pdf):
            continue
        columns = {name: pdf[name].to_numpy() for name in pdf.columns}
        chunks, keys = columns.pop(CHUNK), columns.pop(KEY)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pdf)]):
            yield chunks[low], keys[low], {name: values[low:high] for name, values in columns.items()}


def _load(entries: dict[int, bytes], chunk: int) -> Any:
    return pickle.loads(entries[chunk]) if chunk in entries else None


def _exits(fold: Fold, wanted: dict[int, Any], entries: dict[int, bytes]) -> Callable:
    """Fold the last key of each wanted chunk and report the state it ends in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[int, Any] = {}
        for chunk, key, rows in _slices(batches):
            if wanted[chunk] == key:
                state = states[chunk] if chunk in states else _load(entries, chunk)
                states[chunk], _ = fold.step(state, rows)
        if states:
            exits = [pickle.dumps(s) for s in states.values()]
            yield pd.DataFrame({"chunk": np.array(list(states), dtype=np.int32), "state": exits})

    return run


class _Output:
    """Decisions gathered into frames of some thousand rows."""

    def __init__(self) -> None:
        self.parts: list[Columns] = []
        self.rows = 0

    def add(self, part: Columns | None) -> None:
        if part is not None and len(part["seq"]):
            self.parts.append(part)
            self.rows += len(part["seq"])

    def take(self) -> pd.DataFrame:
        frame = pd.DataFrame({name: np.concatenate([p[name] for p in self.parts]) for name in self.parts[0]})
        self.parts, self.rows = [], 0
        return frame


def _decide(fold: Fold, entries: dict[int, bytes], open_ended: set[int]) -> Callable:
    """Fold every key of every chunk and emit the decisions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, out = None, None, _Output()
        for chunk, key, rows in _slices(batches):
            if at != (chunk, key):
                if at is not None and (at[0] == chunk or at[0] not in open_ended):
                    out.add(fold.finish(state))
                state = None if at is not None and at[0] == chunk else _load(entries, chunk)
                at = (chunk, key)
            state, decided = fold.step(state, rows)
            out.add(decided)
            if out.rows >= _OUTPUT_ROWS:
                yield out.take()
        if at is not None and at[0] not in open_ended:
            out.add(fold.finish(state))
        if out.rows:
            yield out.take()

    return run


def _run_exits(ordered: DataFrame, fold: Fold, chunks: Iterable[_Chunk], entries: dict[int, bytes]) -> None:
    """Fold the last key of the given chunks and note the state each ends in."""
    by_index = {c.index: c for c in chunks}
    wanted = {i: c.last for i, c in by_index.items()}
    # What a chunk receives belongs to its first key, so only a chunk inside one key hands it on.
    entries = {i: entries[i] for i, c in by_index.items() if c.single and i in entries}
    rows = ordered.where(F.col(CHUNK).isin(list(wanted)))
    for row in rows.mapInPandas(_exits(fold, wanted, entries), "chunk int, state binary").collect():
        by_index[row["chunk"]].exit = bytes(row["state"])


def _chains(chunks: list[_Chunk]) -> list[list[_Chunk]]:
    """Each run of chunks that share a key across their boundaries."""
    chains: list[list[_Chunk]] = []
    for a, b in zip(chunks, chunks[1:]):
        if a.last == b.first:
            if a.single and chains and chains[-1][-1] is a:
                chains[-1].append(b)
            else:
                chains.append([a, b])
    return chains


def _settle_by_steps(ordered: DataFrame, fold: Fold, chains: list[list[_Chunk]]) -> dict[int, bytes]:
    """Entry states of chains, handed through by step functions."""
    handover = fold.handover()
    _run_exits(ordered, fold, [chain[0] for chain in chains], {})
    entries = {chain[1].index: chain[0].exit for chain in chains if len(chain) == 2}
    chains = [chain for chain in chains if len(chain) > 2]
    if not chains:
        return entries
    places, reach, heads, lengths = {}, {}, {}, {}
    for number, chain in enumerate(chains):
        seen = chain[0].latest
        # The last chunk only receives, unless it too lies inside the key.
        for pos, chunk in enumerate(chain[1:-1]):
            places[chunk.index] = (number, pos)
            reach[chunk.index] = seen
            seen = max(seen, chunk.latest)
        heads[number] = fold.to_time(pickle.loads(chain[0].exit))
        lengths[number] = len(chain) - 2
    steps = chunk_steps(ordered, CHUNK, handover, places, reach)
    through = hand_through(steps, handover, heads, lengths)
    for number, chain in enumerate(chains):
        for pos, chunk in enumerate(chain[1:-1]):
            entries[chunk.index] = pickle.dumps(fold.from_time(through[(number, pos)][0]))
        entries[chain[-1].index] = pickle.dumps(fold.from_time(through[(number, lengths[number] - 1)][1]))
    return entries


def _settle(ordered: DataFrame, fold: Fold, chunks: list[_Chunk]) -> dict[int, bytes]:
    """The state each chunk starts from, for the chunks whose first key continues from the one before."""
    chains = _chains(chunks)
    if fold.handover():
        return _settle_by_steps(ordered, fold, chains) if chains else {}
    entries: dict[int, bytes] = {}
    links = [link for chain in chains for link in zip(chain, chain[1:])]
    if fold.merge and links:
        # One job for what each chunk adds, then a running merge.
        _run_exits(ordered, fold, {a.index: a for a, _ in links}.values(), {})
        for a, b in links:
            own = pickle.loads(a.exit)
            through = a.single and a.index in entries
            entries[b.index] = pickle.dumps(fold.merge(pickle.loads(entries[a.index]), own) if through else own)
        return entries
    stale = {a.index: a for a, _ in links}
    feeds = {b.index: a for a, b in links}
    rounds = 0
    while stale:
        _run_exits(ordered, fold, stale.values(), entries)
        rounds += 1
        # Entry states that came out different. A chunk that ends in another key does not pass them on.
        changed = {i: a.exit for i, a in feeds.items() if a.exit is not None and entries.get(i) != a.exit}
        if rounds > SPECULATIVE_ROUNDS:
            # Only take over states whose own chunk is up to date, so each chunk is folded once more at most.
            changed = {i: s for i, s in changed.items() if not (feeds[i].single and feeds[i].index in changed)}
        entries.update(changed)
        stale = {a.index: a for a, _ in links if a.single and a.index in changed}
    return entries


def chunked_fold(
    df: DataFrame, key: Column, order: list[str], fold: Fold, schema: str, partitions: int | None = None
) -> DataFrame:
    """Fold ``df`` per ``key`` in ``order``; returns the decisions with the given ``schema``.

    ``key`` is a string. ``order`` must be unique within it. ``df`` should hold only the columns the fold reads.
    """
    ship_package(df.sparkSession)
    keyed = df.withColumn(KEY, key)
    by = [KEY, *order]
    ranged = keyed.repartitionByRange(partitions, *by) if partitions else keyed.repartitionByRange(*by)
    # The chunk number is stored with the rows: a task's own number changes when its stage has more inputs.
    ordered = checkpoint(ranged.sortWithinPartitions(*by).withColumn(CHUNK, F.spark_partition_id()))
    latest = [F.max("t")] if fold.handover() else []
    edges = ordered.groupBy(CHUNK).agg(F.min(KEY), F.max(KEY), *latest).collect()
    chunks = [_Chunk(*row) for row in sorted(tuple(r) for r in edges)]
    entries = _settle(ordered, fold, chunks)
    open_ended = {a.index for a, b in zip(chunks, chunks[1:]) if a.last == b.first}
    return ordered.mapInPandas(_decide(fold, entries, open_ended), schema)
