"""Step functions of chunks against the folds they stand for, and long chains on Spark against a model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_folds import BASE, by_source, ids, in_arrival, make_rows, throttle_model

from logloom.operators import chunked, handover, stateful
from logloom.operators.folds import AnchorFold, ThrottleFold


@pytest.mark.parametrize("strict", [True, False])
def test_steps_agree_with_the_fold(strict):
    rng = random.Random(strict)
    for _ in range(400):
        width, n = rng.randrange(1, 30), rng.randrange(3, 40)
        times = [rng.randrange(0, 80) for _ in range(n)]
        if strict:
            times.sort()
        fold = ThrottleFold(width, 1) if strict else AnchorFold(width)
        cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randrange(2, 5))))
        parts = [np.array(times[a:b]) for a, b in zip([0, *cuts], [*cuts, n])]

        def exit_of(state, part):
            return fold.pick(state, part.tolist())[0] if strict else fold.starts(state, part)[0]

        state = exit_of(None, parts[0])
        hand, seen, total = fold.handover(), max(times[: cuts[0]]), None
        head = np.array([fold.to_time(state)])
        for part in parts[1:]:
            steps = hand.steps(part, seen)
            seen = max(seen, int(part.max()))
            total = steps if total is None else hand.compose(total, steps)
            state = exit_of(state, part)
            assert hand.follow(total, head)[0] == fold.to_time(state)


@pytest.fixture
def small_tree(monkeypatch):
    monkeypatch.setattr(handover, "FAN", 3)
    calls = []
    real = chunked._settle_by_steps

    def record(*args):
        entries = real(*args)
        calls.append(dict(entries))
        return entries

    monkeypatch.setattr(chunked, "_settle_by_steps", record)
    return calls


def test_saturated_throttle(logs, small_tree):
    rows = make_rows(random.Random(2), 500, ["a", "b"], 0.05)
    got = stateful.throttle_logs(logs(rows), 2, key=F.lit("k"), partitions=16)
    assert ids(got) == throttle_model(rows, 2, 1, lambda r: "k")
    assert small_tree and small_tree[0]


def test_anchored_windows_of_one_large_source(logs, small_tree):
    from datetime import timedelta

    rows = make_rows(random.Random(6), 500, ["a"], 0.1, jitter=4.0)
    expected, start = {}, None
    for row in by_source(rows, in_arrival)["a"]:
        if start is None or row["ts"] >= start + timedelta(seconds=3):
            start = row["ts"]
        expected[row["seq"]] = round((start - BASE).total_seconds() * 1e6)
    got = stateful.anchored_windows(logs(rows), 3, partitions=14)
    base = int(BASE.timestamp()) * 1_000_000
    assert {r["seq"]: r["w"] - base for r in got.select("seq", F.unix_micros("window_start").alias("w")).collect()} == expected
    assert small_tree and small_tree[0]
