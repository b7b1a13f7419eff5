"""The stages against brute-force versions of what each decides, on its own input."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from llm.conftest import DOCS, prose
from llm.test_jaccard import brute, word_sets
from llm.test_quality import noise
from logloom.llm import boosting, classifier, mixing, statistics

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean and noisy documents, near copies, odd texts, labels for most."""
    r = random.Random(9)
    texts = [prose(i, 60 + i % 80) if i % 5 else noise(i) for i in range(220)]
    texts += [t + " more" for t in texts[:20]] + texts[30:40] + [None, "", "a b", prose(77, 4000)]
    rows = [(i, t, "en", r.choice(["a", "a", "a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(200)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return tuple(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_filters_keep_what_the_models_keep(spark, tables, sf_dir):
    docs, labels = tables
    rows = rows_of(docs)
    counts, x = statistics.measure_all([r[1] or "" for r in rows])
    model = classifier.fit_classifier(docs, labels)
    good = model.score(x) >= 0.5
    assert rows_of(pipeline.quality_classifier(spark, docs, sf_dir)) == [r for r, g in zip(rows, good) if g]
    forest = boosting.fit_rules(docs, labels)
    good = (forest.score(x) >= 0.5) & (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0])
    assert rows_of(pipeline.quality_rules(spark, docs, sf_dir)) == [r for r, g in zip(rows, good) if g]
    clean = {r[0] for r in rows if r[0] < 220 and r[0] % 5}
    kept = {r[0] for r in rows_of(pipeline.quality_classifier(spark, docs, sf_dir))}
    assert len(clean - kept) <= 0.02 * len(clean) and not {r[0] for r in rows if r[0] < 220 and not r[0] % 5} & kept


def test_one_of_each_group_stays(spark, tables, sf_dir):
    docs = tables[0]
    rows = rows_of(docs)
    names = {d for d, _, c in brute([(r[0], r[1]) for r in rows]) if d == c}
    got = pipeline.near_duplicates(spark, docs, sf_dir)
    assert got.columns == COLUMNS and rows_of(got) == [r for r in rows if r[0] in names]


def test_groups_share_four_fifths_of_five_word_shingles(spark, sf_dir, docs):
    r = random.Random(3)
    base = prose(500, 100)
    rows = [(0, base)]
    for i in range(1, 60):
        words = base.split(" ") if i % 3 else prose(500 + i, 100).split(" ")
        for place in r.sample(range(0, 100, 7), i % 6):
            words[place] = f"w{i}x{place}"
        rows.append((i, " ".join(words)))

    def groups(width, percent):
        def alike(a, b):
            common = len(a & b)
            return common and 100 * common >= percent * (len(a) + len(b) - common)

        sets = [word_sets(t, width) for _, t in rows]
        label = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and alike(sets[i], sets[j]):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
        return {i for i, x in enumerate(label) if i == x}

    # One word in 49 replaced: 40 of 50 five-word shingles shared, and 42 of 50 four-word ones.
    pair = prose(900, 49).split(" ")
    rows += [(60, " ".join(pair)), (61, " ".join([*pair[:24], "other", *pair[25:]]))]
    want = groups(5, 80)
    assert want != groups(4, 85)
    assert {x["doc_id"] for x in pipeline.near_duplicates(spark, docs(rows), sf_dir).collect()} == want


def test_one_row_of_each_group_stays_where_ids_repeat_or_are_missing(spark, sf_dir, docs):
    one, two, three = prose(801, 60), prose(802, 60), prose(803, 60)
    rows = [(1, one), (7, two), (7, one + " more"), (7, three), (None, two + " end"), (None, one), (None, "new"), (None, "new"), (None, None)]
    rows += [(7, three), (9, three), (None, " "), (8, None), (8, None), (4, "")]
    got = pipeline.near_duplicates(spark, docs(rows), sf_dir).collect()
    want = [(1, one), (7, two), (7, three), (None, "new"), (None, None), (None, " "), (8, None), (4, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_mix_repeats_rows(spark, tables, sf_dir):
    docs = tables[0]
    times = {r["doc_id"]: r["times"] for r in mixing.mix_sources(docs).collect()}
    got = pipeline.mix(spark, docs, sf_dir)
    assert got.columns == COLUMNS
    assert rows_of(got) == sorted((r for r in rows_of(docs) for _ in range(times[r[0]])), key=str)


def test_run_is_the_stages_one_after_the_other(spark, tables, sf_dir, tokenizer):
    docs = tables[0]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == COLUMNS, name
    packed = pipeline.run(spark, sf_dir).collect()
    want = Counter((r["doc_id"], len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    whole = Counter()
    for r in packed:
        whole[r["doc_id"]] += r["length"]
    expected = Counter()
    for (doc, n), k in want.items():
        expected[doc] += n * k
    assert whole == expected
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= np.ceil(sum(fill.values()) / 2048) + 1


def test_odd_rows(spark, sf_dir, docs, odd_texts):
    rows = [(i, t, "a") for i, t in enumerate(odd_texts)] + [(5, odd_texts[5], "a"), (5, "other text", None), (None, "no id", "b"), (None, None, "b"), (5, odd_texts[5], "a")]
    odd = docs(rows)
    for name, stage in pipeline.STAGES:
        for table in (odd, odd.limit(0), docs([])):
            got = stage(spark, table, sf_dir)
            got.collect()
            if stage is not pipeline.pack:
                assert got.columns == odd.columns, name
    left = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, odd, sf_dir).collect()]
    assert len(left) == len(set(left)) and {(5, "other text"), (None, "no id"), (None, None)} <= set(left)
    times = Counter(r["doc_id"] for r in pipeline.mix(spark, odd, sf_dir).collect())
    want = Counter()
    for r in mixing.mix_sources(odd).collect():
        want[r["doc_id"]] += r["times"]
    assert times == +want


def test_entry_lists_every_query(spark):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
