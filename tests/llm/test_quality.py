import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm.conftest import prose
from logloom.llm import boosting, classifier, statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


def test_counts_equal_brute_force(odd_texts):
    @settings(max_examples=300)
    @given(st.lists(st.sampled_from(["a", "b", "A", " ", "\n", "é", "#", "|x", "\t", " ", "a b a b a", "\n\n", "same line\n"]), max_size=30).map("".join))
    def check(text):
        assert statistics.measure(text)[0] == brute_counts(text)

    check()
    for t in odd_texts:
        assert statistics.measure(t or "")[0] == brute_counts(t)
        assert np.isfinite(statistics.measure(t or "")[1]).all()


def noise(i):
    r = random.Random(i)
    return " ".join(w + r.choice(["***", "$$$", "&&&"]) for w in prose(i, r.randint(60, 200)).split())


@pytest.fixture(scope="module")
def tables(spark, docs):
    rows = [(i, prose(i, 60 + i % 90) if i % 4 else noise(i)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), "x") for i in range(400)] + [(1, 1, "x"), (None, 0, "x"), (2, None, "x")], "doc_id long, quality int, features string")
    return docs(rows), labels, rows


def test_classifier_on_held_out_rows(spark, docs, tables, odd_texts):
    table, labels, rows = tables
    model = classifier.fit_classifier(table, labels, waves=64)
    again = classifier.fit_classifier(table.repartition(7), labels, waves=64)
    odd = docs([(900 + i, t) for i, t in enumerate(odd_texts)])
    both = table.unionByName(odd)
    scored = lambda m: {r[0]: r[1] for r in both.select("doc_id", classifier.quality_score(m, F.col("text"))).collect()}
    got, repeated = scored(model), scored(again)
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 4 > 0) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    assert max(abs(got[i] - repeated[i]) for i in got) < 1e-6


def test_held_out_labels_are_not_used(spark, tables):
    table, labels, _ = tables
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (statistics.labelled_sample(table, x, "quality", 100).collect() for x in (labels, flipped))
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == 100


def test_without_labels(docs, tables):
    table, labels, _ = tables
    none = labels.limit(0)
    model = classifier.fit_classifier(table, none)
    assert {r[0] for r in table.limit(5).select(classifier.quality_score(model, F.col("text"))).collect()} == {0.5}
    forest = boosting.fit_rules(table, none)
    assert boosting.quality_rules(table, forest).where("NOT verdict.base_failed AND NOT verdict.kept").count() == 0
    assert docs([]).select(classifier.quality_score(model, F.col("text"))).count() == 0
    assert boosting.quality_rules(docs([]), forest).count() == 0


def test_isotonic_is_the_closest_rising_line():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = int(r.integers(1, 12))
        x, k = np.arange(n, dtype=float), r.integers(1, 5, n).astype(float)
        total = r.integers(0, 5, n) * k / 4
        knots, values = classifier.pool_adjacent(x, total, k)
        assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
        # Min-max formula of isotonic regression.
        fit = [max(min(total[i : j + 1].sum() / k[i : j + 1].sum() for j in range(m, n)) for i in range(m + 1)) for m in range(n)]
        assert np.allclose(sorted(set(np.round(fit, 9))), sorted(set(np.round(values, 9))))


def test_trees_keep_constraints_and_equal_a_walk():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] - np.abs(x[:, 1]) + r.normal(size=3000) > 0) ^ (r.random(3000) < 0.1)).astype(float)
    forest = boosting.boost(x, y, [1, 0, -1, 0], trees=20, depth=3)
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.7
    for f, sign in ((0, 1), (2, -1)):
        grid = np.repeat(x[:50], 30, axis=0)
        grid[:, f] = np.tile(np.linspace(-3, 3, 30), 50)
        steps = np.diff(forest.margin(grid).reshape(50, 30), axis=1)
        assert (sign * steps >= -1e-12).all()
    for row, got in zip(x[:20], forest.margin(x[:20])):
        margin = forest.prior
        for t in range(len(forest.value)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
            margin += forest.value[t, node - forest.feature.shape[1]]
        assert got == pytest.approx(margin)


def test_rules(docs, tables, odd_texts):
    table, labels, rows = tables
    forest = boosting.fit_rules(table, labels)
    got = {r["doc_id"]: r["verdict"] for r in boosting.quality_rules(table, forest).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["kept"] == (i % 4 > 0) for i in held]) > 0.97
    odd = docs([(i, t) for i, t in enumerate(odd_texts)] + [(50, " ".join(["a b c"] * 40)), (51, "w " * 49)])
    for r in boosting.quality_rules(odd, forest).collect():
        v, counts = r["verdict"], brute_counts(r["text"])
        assert [v[c] for c in statistics.COUNTS] == counts
        assert v["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (v["kept"] and v["base_failed"])
