"""Keyword rules through automata against plain substring tests."""

import pytest

from logloom.operators.keywords import classify_by_keywords, keyword_matches

RULES = [(5, "Time Out", "net"), (2, "disk", "storage"), (9, "out", "other"), (2, "full", "storage"), (7, "", "never"), (8, None, "never"), (3, "é", "accent")]
TEXTS = [(1, "Disk FULL after time out"), (2, None), (3, ""), (4, "nothing here"), (5, "timeout"), (6, "ÉTÉ out " + "x" * 100_000)]


def brute(texts, rules):
    out = {}
    for i, text in texts:
        ids = sorted({r for r, k, _ in rules if k and text and k.lower() in text.lower()})
        first = min(((r, c) for r, k, c in rules if r in ids and k and k.lower() in text.lower()), default=(None, "none"))[1]
        out[i] = (ids, first)
    return out


@pytest.mark.parametrize("max_bytes", [1, 20, 1 << 20])
def test_against_substrings(spark, max_bytes):
    rules = spark.createDataFrame(RULES, "rule_id long, keyword string, category string")
    from pyspark.sql import functions as F

    texts = spark.createDataFrame(TEXTS, "id long, message string").withColumn("rules", F.lit("clash"))
    got = keyword_matches(texts, rules, default="none", max_bytes=max_bytes).collect()
    assert {r["id"]: (r["rules"], r["category"]) for r in got} == brute(TEXTS, RULES)


def test_classify_and_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "rule_id long, keyword string, category string")
    texts = spark.createDataFrame(TEXTS, "id long, message string")
    got = {r["id"]: r["category"] for r in classify_by_keywords(texts, rules).collect()}
    assert got == {1: "storage", 2: "uncategorized", 3: "uncategorized", 4: "uncategorized", 5: "other", 6: "accent"}
    assert classify_by_keywords(texts.limit(0), rules).count() == 0
    assert {r["category"] for r in classify_by_keywords(texts, rules.limit(0)).collect()} == {"uncategorized"}
