"""The decisions behind the sequential operators, as folds over the time-ordered rows of a key.

Times are epoch microseconds in column ``t``. The folds that pick rows also serve the streaming operators.
"""

from bisect import bisect_left, bisect_right
from collections import OrderedDict
from heapq import heappush, heappushpop
from typing import Any

import numpy as np

from logloom.operators.chunked import Columns, Fold
from logloom.operators.handover import Handover


class PickFold(Fold):
    """A fold that picks some of the rows it sees."""

    def pick(self, state: Any, times: list[int]) -> tuple[Any, list[int]]:
        """The new state and the positions picked."""
        raise NotImplementedError

    def step(self, state, rows):
        state, picked = self.pick(state, rows["t"].tolist())
        return state, {name: rows[name][picked] for name in ("source", "seq")} if picked else None


class ThrottleFold(PickFold):
    """Pass a row if fewer than ``limit`` passed rows lie within ``width`` before it, both ends included.

    State: the times of the last ``limit`` passed rows.
    """

    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit

    def pick(self, state: list[int] | None, times: list[int]) -> tuple[list[int], list[int]]:
        passed, kept, i = list(state or ()), [], 0
        while i < len(times):
            if len(passed) >= self.limit:
                # Blocked until the limit-th last passed row is out of reach: go straight to that time.
                i = bisect_right(times, passed[-self.limit] + self.width, i)
                if i == len(times):
                    break
            kept.append(i)
            passed.append(times[i])
            i += 1
        return passed[-self.limit :], kept

    def handover(self):
        return Handover(self.width, strict=True) if self.limit == 1 else None

    def to_time(self, state: list[int]) -> int:
        return state[-1]

    def from_time(self, time: int) -> list[int]:
        return [time]


class AlertFold(PickFold):
    """Fire on the row that makes ``threshold`` hits within ``width`` (both ends included), then start over.

    State: the times of the hits since the last alert, as far as they are still in reach.
    """

    def __init__(self, width: int, threshold: int):
        self.width, self.threshold = width, threshold

    def pick(self, state: list[int] | None, times: list[int]) -> tuple[list[int], list[int]]:
        hits, fired = list(state or ()), []
        low = 0
        for i, now in enumerate(times):
            hits.append(now)
            while hits[low] < now - self.width:
                low += 1
            if len(hits) - low >= self.threshold:
                fired.append(i)
                hits, low = [], 0
        return hits[low:], fired


class RuleFolds(Fold):
    """One alert fold per rule; keys hold the rows of one rule and source, with the rule's number in ``rule``."""

    def __init__(self, folds: dict[int, AlertFold]):
        self.folds = folds

    def step(self, state, rows):
        state, picked = self.folds[int(rows["rule"][0])].pick(state, rows["t"].tolist())
        return state, {name: rows[name][picked] for name in ("source", "seq", "rule")} if picked else None


class AnchorFold(Fold):
    """Windows that open at the first row not covered by the last one. Rows come in arrival order.

    A late row joins the current window. State: the start of the current window.
    """

    def __init__(self, width: int):
        self.width = width

    def starts(self, state: int | None, times: np.ndarray) -> tuple[int, np.ndarray]:
        # Only a new latest time can open a window, so search the running maximum.
        latest = np.maximum.accumulate(times).tolist()
        start, out, i = state, np.empty(len(times), dtype=np.int64), 0
        while i < len(latest):
            if start is None or latest[i] >= start + self.width:
                start = int(latest[i])
            j = bisect_left(latest, start + self.width, i)
            out[i:j] = start
            i = j
        return start, out

    def handover(self):
        return Handover(self.width, strict=False)

    def to_time(self, state: int) -> int:
        return int(state)

    def from_time(self, time: int) -> int:
        return time

    def step(self, state, rows):
        state, starts = self.starts(state, rows["t"])
        return state, {"source": rows["source"], "seq": rows["seq"], "window_start": starts}


class DedupFold(Fold):
    """Pass the first ``max_repeats`` rows of a message, remembering at most ``window_size`` messages.

    When a passed row makes the memory too large, the message remembered first is forgotten. State: the
    messages in order of entry with their counts. Counts stop at ``max_repeats`` unless they are reported,
    so that states agree sooner.
    """

    def __init__(self, window_size: int, max_repeats: int, report: bool = False):
        self.window_size, self.max_repeats, self.report = window_size, max_repeats, report

    def occurrences(self, state: list | None, digests: list[str]) -> tuple[list, list[int]]:
        seen = OrderedDict(state or ())
        out = []
        for digest in digests:
            count = seen.get(digest, 0) + 1
            out.append(count)
            seen[digest] = count if self.report else min(count, self.max_repeats)
            if count <= self.max_repeats and len(seen) > self.window_size:
                seen.popitem(last=False)
        return list(seen.items()), out

    def step(self, state, rows):
        state, counts = self.occurrences(state, rows["digest"].tolist())
        occurrence = np.asarray(counts, dtype=np.int64)
        wanted = occurrence > self.max_repeats if self.report else occurrence <= self.max_repeats
        return state, {"source": rows["source"][wanted], "seq": rows["seq"][wanted], "occurrence": occurrence[wanted]}


class ReorderFold(Fold):
    """A buffer of ``size`` rows that lets the smallest go whenever it overflows.

    Decides for each row which later arrival pushed it out (NULL: the end of the input). State: the buffer.
    """

    def __init__(self, size: int):
        self.size = size

    def _released(self, source: str, rows: list[tuple[tuple[str, int], int | None]]) -> Columns:
        return {
            "source": np.full(len(rows), source, dtype=object),
            "seq": np.array([item[1] for item, _ in rows], dtype=np.int64),
            "released_by": np.array([by for _, by in rows], dtype=object),
        }

    def release(self, heap: list, items: list[tuple[str, int]]) -> list[tuple[tuple[str, int], int]]:
        out = []
        for item in items:
            if len(heap) < self.size:
                heappush(heap, item)
            else:
                out.append((heappushpop(heap, item), item[1]))
        return out

    def merge(self, entry, own):
        """The buffer keeps the ``size`` largest rows of all it has seen, so states of stretches merge."""
        return entry[0], sorted([*entry[1], *own[1]])[-self.size :]

    def step(self, state, rows):
        source, heap = state or (rows["source"][0], [])
        heap = list(heap)
        out = self.release(heap, list(zip(rows["sort_key"].tolist(), rows["seq"].tolist())))
        # A sorted list is a heap, and equal buffers compare equal.
        return (source, sorted(heap)), self._released(source, out)

    def finish(self, state: Any) -> Columns | None:
        if state is None:
            return None
        source, heap = state
        return self._released(source, [(item, None) for item in heap])
