"""Quality rules: counted limits first, then gradient-boosted trees with monotonic constraints.

Trees are grown level by level from histograms of binned statistics. A feature constrained to fall may only be split so
that the upper side scores no higher, and the middle of the two values bounds both sides' offspring. Trees are complete
and flattened into numpy arrays (node i has children 2i + 1 and 2i + 2), so all rows walk all trees at once.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import statistics
from logloom.workers import ship_package

#: -1: more of it never makes a text better.
FALLING = {"symbols_per_word": -1, "exclaims_per_word": -1, "bars_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "stutter_share": -1}


@dataclass
class Forest:
    """``feature`` and ``threshold`` are (trees, inner nodes), ``value`` is (trees, leaves); margins are log odds."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    prior: float
    depth: int

    def margin(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(self.value):
            return out
        trees = np.arange(len(self.value))
        for begin in range(0, len(x), block):
            rows = x[begin : begin + block]
            node = np.zeros((len(rows), len(trees)), np.int64)
            for _ in range(self.depth):
                above = rows[np.arange(len(rows))[:, None], self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + above
            out[begin : begin + block] += self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _grow(bins, gradient, hessian, edges, signs, depth, least, smooth, rate):
    """One tree: (features, thresholds, leaf values)."""
    inner, n_bins = 2**depth - 1, max(len(e) for e in edges) + 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    bounds = np.tile([-np.inf, np.inf], (2 ** (depth + 1) - 1, 1))
    node = np.zeros(len(bins), np.int64)
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        best = [(0.0, 0, 0, 0.0, 0.0)] * width
        for f, sign in enumerate(signs):
            if not len(edges[f]):
                continue
            at = (node - first) * n_bins + bins[:, f]
            g = np.bincount(at, gradient, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
            h = np.bincount(at, hessian, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
            gl, hl = g[:, :-1], h[:, :-1]
            gr, hr = g[:, -1:] - gl, h[:, -1:] - hl
            lo, hi = bounds[first : first + width, :1], bounds[first : first + width, 1:]
            left, right = np.clip(-gl / (hl + smooth), lo, hi), np.clip(-gr / (hr + smooth), lo, hi)
            whole = np.clip(-g[:, -1:] / (h[:, -1:] + smooth), lo, hi)
            worth = lambda v, a, b: -(2 * a * v + (b + smooth) * v * v)
            gain = worth(left, gl, hl) + worth(right, gr, hr) - worth(whole, g[:, -1:], h[:, -1:])
            gain[(hl < least) | (hr < least) | (sign * (right - left) < 0)] = -1
            for k in range(width):
                j = int(gain[k].argmax())
                if j < len(edges[f]) and gain[k, j] > best[k][0] + 1e-9:
                    best[k] = (gain[k, j], f, j, left[k, j], right[k, j])
        for k, (gain, f, j, left, right) in enumerate(best):
            i = first + k
            bounds[2 * i + 1 : 2 * i + 3] = bounds[i]
            if gain > 0:
                feature[i], threshold[i] = f, edges[f][j]
                if signs[f]:
                    middle = (left + right) / 2
                    bounds[2 * i + 1, 1 if signs[f] > 0 else 0] = middle
                    bounds[2 * i + 2, 0 if signs[f] > 0 else 1] = middle
        cut = np.full(inner, n_bins)
        for k in range(width):
            if best[k][0] > 0:
                cut[first + k] = best[k][2]
        node = 2 * node + 1 + (bins[np.arange(len(bins)), feature[node]] > cut[node])
    leaf = node - inner
    g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, hessian, inner + 1)
    value = np.clip(-g / (h + smooth), bounds[inner:, 0], bounds[inner:, 1])
    return feature, threshold, rate * value


def boost(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, n_bins: int = 64, least: float = 2.0, smooth: float = 1.0) -> Forest:
    """Logistic boosting on rows of ``x``; sums over features keep the order of rows, so reruns agree."""
    if not len(y):
        return Forest(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), 0.0, depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    margin, grown = np.full(len(y), prior), []
    for _ in range(trees if 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(bins, p - y, p * (1 - p), edges, signs, depth, least, smooth, rate)
        grown.append(tree)
        margin += Forest(tree[0][None], tree[1][None], tree[2][None], 0.0, depth).margin(x)
    parts = list(zip(*grown)) or [np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth))]
    return Forest(*(np.array(p) for p in parts), prior, depth)


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 40_000, **options) -> Forest:
    """Trees from at most ``max_labelled`` labelled rows outside the held-out third, fitted on the driver.

    Without labelled documents of both kinds there are no trees and only the counted limits decide.
    """
    rows = statistics.labelled_sample(docs, labels, label, max_labelled).toPandas()
    x = np.array(rows["features"].to_list(), np.float64).reshape(len(rows), len(statistics.FEATURES))
    y = rows["label"].to_numpy(np.float64)
    order = np.lexsort(np.column_stack([y, x]).T) if len(y) else []
    return boost(x[order], y[order], [FALLING.get(f, 0) for f in statistics.FEATURES], **options)


_VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(text, forest: Forest, least_words: int = 50, most_repeats: int = 50):
    """A struct column of counts and the verdict.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeats`` percent of them repeated. Null and empty
    texts have no words, so they fail. ``kept``: not failed, and the trees' score is at least one half.
    """

    @F.pandas_udf(_VERDICT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in statistics.text_series(batches):
            counts, x = statistics.measure_all(rows)
            frame = pd.DataFrame(counts, columns=statistics.COUNTS)
            n, repeats = counts[:, 0], counts[:, 4]
            frame["base_failed"] = (n < least_words) | (100 * repeats > most_repeats * n)
            frame["score"] = forest.score(x)
            frame["kept"] = ~frame["base_failed"] & (frame["score"] >= 0.5)
            yield frame

    return run(text)


def quality_rules(docs: DataFrame, forest: Forest, text_column: str = "text") -> DataFrame:
    """``docs`` with a struct column ``verdict``; a column of that name is replaced."""
    ship_package(docs.sparkSession)
    return docs.withColumn("verdict", judge(F.col(text_column).cast("string"), forest))
