import random
import zlib
from collections import defaultdict

import numpy as np

from logloom.llm import packing


def brute_best_fit(lengths, capacity):
    """The number of bins of best-fit decreasing, a piece at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, rest in enumerate(bins) if rest >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def place_all(plan, counts):
    used = defaultdict(list)
    for length, n in counts.items():
        rows = plan[plan[:, 0] == length]
        for rank in range(n):
            row = rows[np.searchsorted(rows[:, 1], rank, side="right") - 1]
            nth = rank - row[1]
            used[row[2] + nth // row[3]].append((row[4] + nth % row[3] * length, length))
    return used


def test_runs_equal_one_packer():
    r = random.Random(5)
    for trial in range(200):
        capacity = r.choice([1, 7, 20, 64])
        lengths = [r.randint(1, r.choice([capacity, max(1, capacity // 4)])) for _ in range(r.randint(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used = place_all(packing.plan_best_fit(counts, capacity), counts)
        for bin_ in used.values():
            at = 0
            for offset, length in sorted(bin_):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in b) for b in used.values()) == brute_best_fit(lengths, capacity)
        assert sorted(used) == list(range(len(used)))


def test_tree_finds_the_tightest():
    r = random.Random(6)
    tree, have = packing.CapacityTree(50), set()
    for _ in range(500):
        c = r.randint(0, 50)
        have ^= {c}
        tree.set(c, c in have)
        least = r.randint(0, 50)
        assert tree.tightest(least) == min((h for h in have if h >= least), default=None)


def test_pieces(docs, tokenizer, tokenizer_path, odd_texts):
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(None, "no id"), (5, "same id"), (5, "same id")]
    got = packing.best_fit_pack(docs(rows), tokenizer_path, capacity=256, end_id=0).collect()
    expected = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        pieces = -(-len(ids) // 256)
        first = len(ids) - (pieces - 1) * 256
        cuts = [0, *(first + k * 256 for k in range(pieces))]
        expected += [(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: (x[0] is not None, x)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) == len(brute_best_fit([e[3] for e in expected], 256))


def test_empty_table(docs, tokenizer_path):
    assert packing.best_fit_pack(docs([]), tokenizer_path).count() == 0
