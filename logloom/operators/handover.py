"""States of one number handed through a long row of chunks of the same key, without folding them in turn.

A throttle that passes one row, and windows anchored at their first row, remember a single time: the last
passed row, or the start of the window. The next such row is the first that lies ``width`` or more later. So a
chunk maps the time it receives to the time it hands on by a step function, which it can work out alone. Step
functions compose, and chains that meet stay together, so composed ones get smaller and not larger.

The functions of a chain of chunks are composed in groups of ``FAN``, those again, and so on (up); then the known
time at the head of the chain is followed down the same tree, which gives the time each chunk starts from. Every
group is one task of at most ``FAN`` functions. A chunk's function has at most as many steps as the chunk has rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.checkpoints import materialize

FAN = 32
_SCHEMA = "chain int, pos int, bounds array<long>, exits array<long>, last long"


class Steps(NamedTuple):
    """``exits[j]`` is handed on from the ``j``-th bound on; from ``last`` on, what was received."""

    bounds: np.ndarray
    exits: np.ndarray
    last: int


def _merged(bounds: np.ndarray, exits: np.ndarray, last: int) -> Steps:
    changes = np.flatnonzero(exits[1:] != exits[:-1])
    return Steps(bounds[changes], exits[np.concatenate(([0], changes + 1))], int(last))


@dataclass(frozen=True)
class Handover:
    """``strict``: the next row must lie more than ``width`` later, and not just as much."""

    width: int
    strict: bool

    @property
    def _side(self) -> str:
        return "right" if self.strict else "left"

    def steps(self, times: np.ndarray, reach: int) -> Steps:
        """The step function of a chunk for received times of at most ``reach``."""
        latest = np.maximum.accumulate(times)
        n = len(latest)
        after = np.searchsorted(latest, latest + self.width, self._side)
        end = np.where(after < n, after, np.arange(n))
        while True:
            further = end[end]
            if (further == end).all():
                break
            end = further
        top = min(int(np.searchsorted(latest, reach + self.width, self._side)), n - 1)
        return _merged(latest[:top], latest[end[: top + 1]], latest[-1])

    def follow(self, steps: Steps, received: np.ndarray) -> np.ndarray:
        due = received + self.width
        out = steps.exits[np.searchsorted(steps.bounds, due, self._side)]
        beyond = due >= steps.last if self.strict else due > steps.last
        return np.where(beyond, received, out)

    def compose(self, first: Steps, then: Steps) -> Steps:
        exits = self.follow(then, first.exits)
        if then.last <= first.last:
            return _merged(first.bounds, exits, first.last)
        j = int(np.searchsorted(then.bounds, first.last, "right"))
        bounds = np.concatenate((first.bounds, [first.last], then.bounds[j:]))
        return _merged(bounds, np.concatenate((exits, then.exits[j:])), then.last)


def _read(pdf: pd.DataFrame) -> list[Steps]:
    ordered = pdf.sort_values("pos")
    return [
        Steps(np.asarray(b, dtype=np.int64), np.asarray(e, dtype=np.int64), last)
        for b, e, last in zip(ordered["bounds"], ordered["exits"], ordered["last"])
    ]


def _row(chain: int, pos: int, steps: Steps) -> pd.DataFrame:
    frame = pd.DataFrame({"chain": [chain], "pos": [pos], "bounds": [steps.bounds], "exits": [steps.exits], "last": [steps.last]})
    return frame.astype({"chain": "int32", "pos": "int32"})


def chunk_steps(
    ordered: DataFrame, chunk: str, handover: Handover, places: dict[int, tuple[int, int]], reach: dict[int, int]
) -> DataFrame:
    """One row per chunk with its step function; ``places`` gives each chunk's chain and position in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            for number, rows in pdf.groupby(chunk, sort=False):
                times.setdefault(int(number), []).append(rows["t"].to_numpy())
        for number, parts in times.items():
            yield _row(*places[number], handover.steps(np.concatenate(parts), reach[number]))

    rows = ordered.where(F.col(chunk).isin(list(places))).select(chunk, "t")
    return materialize(rows.mapInPandas(run, _SCHEMA), "steps")


def _up(level: DataFrame, handover: Handover) -> DataFrame:
    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _row(int(key[0]), int(key[1]), reduce(handover.compose, _read(pdf)))

    grouped = level.groupBy("chain", F.floor(F.col("pos") / FAN).cast("int").alias("parent"))
    return materialize(grouped.applyInPandas(compose, _SCHEMA), "steps")


def _down(level: DataFrame, handover: Handover, received: dict[tuple[int, int], int]) -> dict[tuple[int, int], tuple[int, int]]:
    """For every function of a level, the times it receives and hands on, given those its groups receive."""

    def follow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        now = np.array([received[(int(key[0]), int(key[1]))]], dtype=np.int64)
        got, gave = [], []
        for steps in _read(pdf):
            got.append(now[0])
            now = handover.follow(steps, now)
            gave.append(now[0])
        out = pdf[["chain", "pos"]].sort_values("pos")
        return out.assign(got=np.array(got, np.int64), gave=np.array(gave, np.int64))

    grouped = level.groupBy("chain", F.floor(F.col("pos") / FAN).cast("int").alias("parent"))
    rows = grouped.applyInPandas(follow, "chain int, pos int, got long, gave long").collect()
    return {(r["chain"], r["pos"]): (r["got"], r["gave"]) for r in rows}


def hand_through(
    level: DataFrame, handover: Handover, heads: dict[int, int], lengths: dict[int, int]
) -> dict[tuple[int, int], tuple[int, int]]:
    """The times each (chain, position) receives and hands on, given what the head of each chain receives."""
    levels, longest = [level], max(lengths.values())
    while longest > FAN:
        levels.append(_up(levels[-1], handover))
        longest = -(-longest // FAN)
    received = {(chain, 0): time for chain, time in heads.items()}
    through: dict[tuple[int, int], tuple[int, int]] = {}
    for current in reversed(levels):
        through = _down(current, handover, received)
        received = {place: got for place, (got, _) in through.items()}
    return through
