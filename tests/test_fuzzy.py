"""The batch scorer against a direct reading of the definition."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions.fuzzy import PartialScorer, partial_score


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def brute(needle, text):
    if not needle or not text:
        return 100 if needle == text else 0

    def best(short, long):
        m, top = len(short), 0.0
        stretches = [long[max(0, s) : s + m] for s in range(-m + 1, len(long))]
        for part in filter(None, stretches):
            top = max(top, 200.0 * lcs(short, part) / (m + len(part)))
        return top

    short, long = sorted((needle, text), key=len)
    score = best(short, long)
    if len(needle) == len(text):
        score = max(score, best(text, needle))
    return round(score)


SMALL = st.text(alphabet="abcé \n", max_size=14)


@settings(max_examples=300, deadline=None)
@given(SMALL, st.lists(SMALL, max_size=6))
def test_small_texts(needle, texts):
    assert PartialScorer(needle).scores(texts).tolist() == [brute(needle, t) for t in texts]


def test_long_needles_span_several_words():
    rng = random.Random(4)
    for size in (63, 64, 65, 129, 200):
        needle = "".join(rng.choice("abcdef ") for _ in range(size))
        texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (10, size - 1, size, size + 1, 300)]
        cut = needle[: size // 2] + "zz" + needle[size // 2 :]
        assert PartialScorer(needle).scores([*texts, cut]).tolist() == [brute(needle, t) for t in [*texts, cut]]


def test_slices_do_not_show():
    import logloom.functions.fuzzy as fuzzy

    texts = ["the quick brown fox jumps", "", "databse", "a database of things " * 4]
    whole = PartialScorer("database").scores(texts)
    old, fuzzy._SLICE = fuzzy._SLICE, 7
    try:
        assert (PartialScorer("database").scores(texts) == whole).all()
    finally:
        fuzzy._SLICE = old


def test_column_scores(logs):
    texts = ["Opening DATABASE now", "databse", None, "", "unrelated"]
    df = logs([dict(message=t) for t in texts])
    rows = df.select("seq", partial_score(F.col("message"), "Database").alias("s")).orderBy("seq").collect()
    assert [r["s"] for r in rows] == [None if t is None else brute("database", t.lower()) for t in texts]
    empty = df.select(partial_score(F.col("message"), "").alias("s"), "seq").orderBy("seq").collect()
    assert [r["s"] for r in empty] == [0, 0, None, 100, 0]


def test_bound_is_never_below_the_score(spark):
    import random

    from logloom.functions.fuzzy import PartialScorer, score_bound

    r = random.Random(4)
    words = ["time out", "timeout", "disk", "ab", "a", "connection refused", "ÉÉ x"]
    texts = ["".join(r.choice("abcdeimnotu éx") for _ in range(r.randint(0, 40))) for _ in range(300)] + ["", "TIME OUT now", "t"]
    df = spark.createDataFrame([(t,) for t in texts], "message string")
    for word in words:
        bounds = [r[0] for r in df.select(score_bound(F.col("message"), word)).collect()]
        scores = PartialScorer(word.lower()).scores([t.lower() for t in texts])
        assert all(b + 0.5 + 1e-9 >= s for b, s in zip(bounds, scores))  # scores are rounded


def test_pruned_filter_keeps_the_same_rows(spark):
    import random

    from logloom.operators.filters import fuzzy_filter

    r = random.Random(8)
    texts = ["".join(r.choice("abcdeimnotu ") for _ in range(r.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, message string")
    for word, threshold in (("time out", 70), ("mint", 90), ("", 50), ("a", 100)):
        plain = {r[0] for r in df.where(partial_score(F.col("message"), word) >= threshold).select("seq").collect()}
        assert {r[0] for r in fuzzy_filter(df, word, threshold).select("seq").collect()} == plain
