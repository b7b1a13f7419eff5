import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.conftest import prose
from logloom.llm import jaccard, shingles
from logloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(text, width=4):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width))))


def brute(rows, percent=85):
    sets = [word_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(smallest.get(find(i), d), d)
    return sorted(((d, len(sets[i]), smallest.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"e{r.randint(0, 10**6)}" if r.random() < share else w for w in text.split(" "))


def corpus(seed):
    """Exact copies, near copies around the threshold, chains, and a passage that many documents share."""
    r = random.Random(seed)
    base = [prose(seed * 100 + i, 80) for i in range(6)]
    passage = prose(seed + 999, 60)
    texts = []
    for b in base:
        texts += [b, b, b.upper()] + [edited(b, r.random(), share) for share in (0.01, 0.02, 0.03, 0.04, 0.06) for _ in range(4)]
        chain = b
        for _ in range(5):
            chain = edited(chain, r.random(), 0.02)
            texts.append(chain)
    texts += [passage + " " + prose(r.random(), k) for k in (1, 2, 3, 5, 8, 12, 40) for _ in range(3)]
    texts += ["a", "A", "a b", "a b c", "a b c d", "A  b\nc\td", None, "", " \n", prose(1, 3000), "é É", "é é"]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    rows = corpus(seed) + [(None, "a b c d"), (3, "x y z w v"), (3, "x y z w v"), (None, "no id at all here")]
    got = jaccard.shingle_table(docs(rows), 4, 85, "doc_id", "text", block_shingles=700)
    assert got.count() == len(rows)
    found = jaccard.similarity_components(docs(rows).repartition(3))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_document_tables_are_spread_over_the_buckets(docs):
    rows = docs([(i, f"text number {i} of a few words") for i in range(400)]).repartition(24).select("doc_id", "text")
    blocks = rows.mapInArrow(jaccard._blocks(4, 32, 1 << 20), jaccard._BLOCK).where("kind = 0").select("bucket", "part").collect()
    assert len({b["part"] for b in blocks}) == len(blocks) == 24
    assert len({b["bucket"] for b in blocks}) > 8 and all(0 <= b["bucket"] < 32 for b in blocks)


def test_empty(docs):
    assert jaccard.similarity_components(docs([])).count() == 0


def test_filters_never_lose_a_similar_pair():
    @settings(max_examples=500)
    @given(st.integers(0, 10**9), st.integers(1, 60), st.integers(0, 12), st.integers(0, 12))
    def check(seed, shared, only_a, only_b):
        r = np.random.default_rng(seed)
        values = r.choice(10_000, shared + only_a + only_b, replace=False).astype(np.uint64)
        a, b = np.sort(values[: shared + only_a]), np.sort(np.concatenate([values[:shared], values[shared + only_a :]]))
        similar = 100 * shared >= 85 * (shared + only_a + only_b)
        assert jaccard.overlap_if_similar(a, b, len(a), len(b), 85) == (shared if similar else None)
        if similar:
            n = [jaccard.prefix_length(len(x), 85) for x in (a, b)]
            assert set(a[: n[0]].tolist()) & set(b[: n[1]].tolist())

    check()


def test_shingle_hashes_agree_with_words():
    rows = [t or "" for _, t in corpus(4)] + ["x" * 70_000 + " a b c", "X" * 70_000 + "\na b\tC", "z " * 700_000]
    sets = [word_sets(t) for t in rows]
    hashed = shingles.shingle_sets(rows, 4)
    known = {}
    for words, found in zip(sets, hashed):
        assert len(words) == len(found)
        assert (np.diff(found.astype(object)) > 0).all()
        assert known.setdefault(frozenset(words), found.tobytes()) == found.tobytes()
    assert len({f.tobytes() for f in hashed}) == len(known)


def test_components(spark):
    r = random.Random(8)
    links = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {n: find(n) for n in parent}
