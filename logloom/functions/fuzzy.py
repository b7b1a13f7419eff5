"""Partial fuzzy score of a keyword against messages.

The score is the best normalised insert/delete similarity, from 0 to 100 and rounded, of the shorter text
against every stretch of the longer one: full-length stretches, and shorter ones at both ends. Similarity
of two texts is ``2 * LCS / (length a + length b)``, where LCS is their longest common subsequence.

A whole Arrow batch is scored at once. All its messages are laid out in one code-point array, separated by
padding, and the bit-parallel LCS recurrence advances every stretch of every message together, so Python
runs once per keyword character and not once per message.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logloom.workers import ship_package

_PAD = 0x110000
_WORD = 64
# Stretches advanced together: few enough for the CPU cache, whatever the message length.
_SLICE = 1 << 15
# Code points laid out together; a longer text comes alone.
_LAID_OUT = 1 << 22
# Texts up to this many times the keyword's length are counted for the native bound of the score.
_COUNTED = 16


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class PartialScorer:
    """Scores texts against one needle."""

    def __init__(self, needle: str):
        self.needle = _code_points(needle)
        self.size = len(self.needle)
        words = max(1, -(-self.size // _WORD))
        self.alphabet, index = np.unique(self.needle, return_inverse=True)
        # masks[w][s]: bit i is set when needle position 64 * w + i holds symbol s; the last symbol is "other".
        self.masks = np.zeros((words, len(self.alphabet) + 1), dtype=np.uint64)
        for pos, symbol in enumerate(index):
            self.masks[pos // _WORD, symbol] |= np.uint64(1) << np.uint64(pos % _WORD)

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, len(self.alphabet)).astype(np.int32)

    def _lcs(self, symbols: np.ndarray, low: int, high: int) -> np.ndarray:
        """LCS of the needle with the stretch of its own length at every start in ``[low, high)``."""
        near = symbols[low : high + self.size - 1]
        masks = [mask[near] for mask in self.masks]
        n = high - low
        rows = [np.full(n, ~np.uint64(0)) for _ in masks]
        for step in range(self.size):
            carry = None
            for w, mask in enumerate(masks):
                hit = rows[w] & mask[step : step + n]
                total = rows[w] + hit
                rest = rows[w] ^ hit
                if len(masks) > 1:
                    overflow = total < hit
                    if carry is not None:
                        total += carry
                        overflow |= total < carry
                    carry = overflow.astype(np.uint64)
                rows[w] = total | rest
        found = np.zeros(n, dtype=np.int64)
        for w, row in enumerate(rows):
            bits = min(_WORD, self.size - w * _WORD)
            used = ~np.uint64(0) if bits == _WORD else np.uint64((1 << bits) - 1)
            found += np.bitwise_count(~row & used)
        return found

    def _slide(self, texts: list[np.ndarray]) -> np.ndarray:
        """Best score over the stretches of each text, none shorter than the needle."""
        margin = np.full(self.size - 1, _PAD, dtype=np.uint32)
        parts = [margin]
        for text in texts:
            parts += (text, margin)
        symbols = self._symbols(np.concatenate(parts))
        lengths = np.array([len(t) for t in texts])
        counts = lengths + self.size - 1
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        best = np.zeros(len(texts))
        total = int(counts.sum())
        for low in range(0, total, _SLICE):
            starts = np.arange(low, min(low + _SLICE, total))
            owner = np.searchsorted(first, starts, side="right") - 1
            # Characters of the text inside the stretch; the rest is padding at one end.
            offset = starts - first[owner] - (self.size - 1)
            inside = np.minimum(offset + self.size, lengths[owner]) - np.maximum(offset, 0)
            score = 200.0 * self._lcs(symbols, low, low + len(starts)) / (self.size + inside)
            np.maximum.at(best, owner, score)
        return best

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        if self.size == 0:
            # Two empty texts are alike; an empty keyword is unlike any other text.
            return np.array([0 if t else 100 for t in texts], dtype=np.int64)
        codes = [_code_points(t) for t in texts]
        lengths = np.array([len(c) for c in codes])
        batch, held = [], 0
        for i in np.flatnonzero(lengths >= self.size).tolist():
            if batch and held + lengths[i] > _LAID_OUT:
                out[batch] = np.rint(self._slide([codes[j] for j in batch]))
                batch, held = [], 0
            batch.append(i)
            held += int(lengths[i]) + self.size
        if batch:
            out[batch] = np.rint(self._slide([codes[j] for j in batch]))
        # The shorter text is the one that slides; of equal ones, both do. Equal texts are scored once.
        needle = [_code_points(self.needle.tobytes().decode("utf-32-le", "surrogatepass"))]
        known: dict[str, int] = {}
        for i in np.flatnonzero((lengths <= self.size) & (lengths > 0)).tolist():
            if texts[i] not in known:
                known[texts[i]] = int(np.rint(PartialScorer(texts[i])._slide(needle)[0]))
            out[i] = max(out[i], known[texts[i]])
        return out


def partial_score(message: Column, keyword: str) -> Column:
    """Score column (0..100) of ``keyword`` against ``message``, both in lower case; NULL stays NULL."""
    needle = keyword.lower()
    ship_package(SparkSession.active())

    @F.pandas_udf("long")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = PartialScorer(needle)
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype="Int64", index=batch.index)
            rows = batch.notna().to_numpy()
            if rows.any():
                out[rows] = scorer.scores(batch[rows].tolist())
            yield out

    lowered = F.lower(message)
    if not needle:
        return F.when(message.isNotNull(), F.when(lowered == "", 100).otherwise(0)).cast("long")
    # A literal hit scores 100, so those texts stay in the JVM.
    hit = F.contains(lowered, F.lit(needle))
    return F.when(hit, F.lit(100).cast("long")).otherwise(score(F.when(~hit, lowered)))


def score_bound(message: Column, keyword: str) -> Column:
    """An upper bound of :func:`partial_score`, in native expressions only.

    Every stretch's LCS with the keyword is at most ``C``, the sum over the keyword's distinct characters of the lesser
    of their counts in keyword and text; a stretch with ``i`` characters of the text scores
    ``200 * min(i, C) / (n + i)``, largest at ``i = C``, where ``n`` is the shorter length. So no score exceeds
    ``200 * C / (n + C)`` (0 where ``C`` is 0). NULL stays NULL.
    """
    needle = keyword.lower()
    lowered = F.lower(message)
    length = F.length(lowered)
    common = F.lit(0)
    for char, count in sorted({c: needle.count(c) for c in set(needle)}.items()):
        found = length - F.length(F.replace(lowered, F.lit(char), F.lit("")))
        common = common + F.least(F.lit(count), found)
    shorter = F.least(length, F.lit(len(needle)))
    return F.when(common > 0, F.lit(200.0) * common / (shorter + common)).otherwise(F.lit(0.0))


def may_reach(message: Column, keyword: str, threshold: int) -> Column:
    """False only where :func:`partial_score` is surely below ``threshold``: a native test, so that such texts never
    reach Python. Literal hits and an empty keyword always pass."""
    needle = keyword.lower()
    if not needle:
        return F.lit(True)
    # Scores are rounded half to even; a bound below threshold - 0.5 rounds below it, as does every score under it.
    # Counting costs a pass over the text per keyword character; a text many times longer than the keyword holds its
    # characters anyway, so it goes to the exact scorer uncounted.
    lowered = F.lower(message)
    short = F.length(lowered) < F.lit(_COUNTED * len(needle))
    bounded = F.when(short, score_bound(message, keyword) >= threshold - 0.5 - 1e-9).otherwise(F.lit(True))
    return F.contains(lowered, F.lit(needle)) | bounded
