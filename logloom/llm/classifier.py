"""Quality scores from random Fourier features, ridge regression and isotonic calibration.

Standardised statistics x are mapped to sqrt(2 / D) cos(W x + b), whose inner products approximate a Gaussian kernel.
Tasks sum the normal equations of their rows by fold; the driver adds the few sums up, solves, and calibrates the raw
scores by pooling adjacent violators over scores of models that did not see the row's fold.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from logloom.llm import statistics
from logloom.workers import ship_package

_BINS = 2000
_FOLDS = 4


@dataclass
class RffModel:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def embed(self, x: np.ndarray) -> np.ndarray:
        """The random features, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases)
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        raw = self.embed(x) @ self.weights
        # A thousandth of the raw score keeps the order within a calibrated step.
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1)


def pool_adjacent(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of means ``total / n`` at ascending ``x``: (block centres, rising values)."""
    blocks: list[list[float]] = []
    for centre, t, k in zip(x, total, n):
        blocks.append([centre * k, t, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def _summed(rows: DataFrame, sums, fit_tasks: int) -> list[np.ndarray]:
    """``sums(x, y, fold)`` (a list of arrays) of each task, added up; one row per task comes to the driver."""

    def run(frames):
        total = None
        for frame in frames:
            x = np.array(frame["features"].to_list(), np.float64).reshape(len(frame), len(statistics.FEATURES))
            if len(x):
                part = sums(x, frame["label"].to_numpy(np.float64), (np.abs(x).sum(axis=1) * 1e6).astype(np.int64) % _FOLDS)
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [[a.tobytes() for a in total]], "shapes": [[list(a.shape) for a in total]]})

    found = rows.coalesce(fit_tasks).mapInPandas(run, "part int, sums array<binary>, shapes array<array<int>>").collect()
    out = None
    for row in sorted(found, key=lambda r: r["part"]):
        part = [np.frombuffer(b, np.float64).reshape(s) for b, s in zip(row["sums"], row["shapes"])]
        out = part if out is None else [a + b for a, b in zip(out, part)]
    return out or []


def fit_classifier(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    max_labelled: int = 40_000,
    waves: int = 256,
    ridge: float = 1e-3,
    fit_tasks: int = 8,
    seed: int = 7,
) -> RffModel:
    """Learn from at most ``max_labelled`` labelled rows outside the held-out third.

    Inputs are statistics of the text only. Without any labelled document every score is 0.5.
    """
    ship_package(docs.sparkSession)
    rows = statistics.labelled_sample(docs, labels, label, max_labelled)
    d = len(statistics.FEATURES)
    random = np.random.default_rng(seed)
    # A kernel as wide as the typical distance of two standardised rows.
    w, b = random.normal(size=(d, waves)) / np.sqrt(d), random.uniform(0, 2 * np.pi, waves)
    none = np.zeros(0)
    moments = _summed(rows, lambda x, y, f: [np.array([float(len(x))]), x.sum(axis=0), (x * x).sum(axis=0)], fit_tasks)
    if not moments:
        return RffModel(none, none, w, b, none, none, none)
    n, total, squares = moments[0][0], moments[1], moments[2]
    mean = total / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 0))
    model = RffModel(mean, np.where(scale > 1e-9, scale, 1.0), w, b, none, none, none)
    embed = model.embed

    def equations(x, y, fold):
        z = embed(x)
        of = [z * (fold == k)[:, None] for k in range(_FOLDS)]
        return [np.stack([a.T @ z for a in of]), np.stack([a.T @ y for a in of])]

    gram, moment = _summed(rows, equations, fit_tasks)

    def solve(g, m):
        shrink = ridge * n * np.eye(len(m))
        shrink[-1, -1] = 1e-9 * n
        return np.linalg.solve(g + shrink, m)

    unseen = np.stack([solve(gram.sum(axis=0) - gram[k], moment.sum(axis=0) - moment[k]) for k in range(_FOLDS)])
    low, high = -0.5, 1.5

    def histogram(x, y, fold):
        raw = np.einsum("ij,ij->i", embed(x), unseen[fold])
        at = np.clip(((raw - low) / (high - low) * _BINS).astype(np.int64), 0, _BINS - 1)
        return [np.bincount(at, minlength=_BINS).astype(float), np.bincount(at, weights=y, minlength=_BINS)]

    counts, ones = _summed(rows, histogram, fit_tasks)
    used = np.flatnonzero(counts)
    centres = low + (used + 0.5) / _BINS * (high - low)
    model.knots, model.values = pool_adjacent(centres, ones[used], counts[used])
    model.weights = solve(gram.sum(axis=0), moment.sum(axis=0))
    return model


def quality_score(model: RffModel, text: Column) -> Column:
    """0 to 1; null and empty texts are scored as texts without words."""
    return statistics.scored(text, model.score)
