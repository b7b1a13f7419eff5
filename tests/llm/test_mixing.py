from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.llm import mixing


def reshared(sizes):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = {s: 0.0 for s in names}, float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def rows_of(seed, n):
    import random

    r = random.Random(seed)
    names = ["a", "b", "Z", "é", None, "tiny", "zero"]
    out = [(i, " ".join(["w"] * min(int(r.paretovariate(1.1)) + 1, 3000)), r.choices(names[:5], [50, 5, 9, 2, 7])[0]) for i in range(n)]
    return out + [(n, "one", "tiny"), (n + 1, None, "zero"), (n + 2, "", "zero"), (n + 5, "w w", "b"), (n + 5, "w w", "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_totals(docs, seed):
    rows = rows_of(seed, 400)
    got = mixing.mix_sources(docs(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    want = reshared(sizes)
    source = {i: s for i, t, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 3
        taken[s] += r["taken"]
    for s in sizes:
        largest = max(r["size"] for r in got if source[r["doc_id"]] == s)
        assert abs(taken[s] - want[s]) <= max(1, largest / 2), (s, taken[s], want[s])


def test_reruns_agree_and_order_does_not_matter(docs):
    rows = rows_of(3, 200)
    first = sorted(map(tuple, mixing.mix_sources(docs(rows)).collect()))
    again = sorted(map(tuple, mixing.mix_sources(docs(rows[::-1]).repartition(5)).collect()))
    assert first == again


def test_preference_raises_the_odds(docs):
    rows = [(i, "w w w", "a" if i < 2000 else "b") for i in range(3000)]
    got = mixing.mix_sources(docs(rows), preference=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(F.lit(None)))
    extra = {r["doc_id"]: r["times"] for r in got.collect()}
    low, high = min(extra[i] for i in range(2000)), [extra[i] for i in range(2000)]
    even = sum(t - low for t in high[::2])
    assert even > 1.3 * sum(t - low for t in high[1::2])


def test_only_native_plans(docs):
    plan = mixing.mix_sources(docs(rows_of(4, 20)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_and_wordless_tables(docs):
    assert mixing.mix_sources(docs([])).count() == 0
    got = mixing.mix_sources(docs([(1, None, "a"), (2, "", None)])).collect()
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
