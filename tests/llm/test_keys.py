"""Exact keys of row contents, with the first hash narrowed so that clashes are common."""

from pyspark.sql import functions as F

from logloom.llm.keys import row_digest, with_unique_keys


def test_keys_are_exact_under_clashes(spark):
    rows = [(i % 150, f"text {i % 150}" if i % 7 else None) for i in range(400)] + [(None, "x"), (None, None), (1, ""), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", row_digest(F.col("doc_id"), F.col("text")))
    got = with_unique_keys(df, "d", "k", bits=3).collect()
    assert len(got) == len(rows)
    by_row, by_key = {}, {}
    for r in got:
        by_row.setdefault((r["doc_id"], r["text"]), set()).add(r["k"])
        by_key.setdefault(r["k"], set()).add((r["doc_id"], r["text"]))
    assert all(len(v) == 1 for v in by_row.values()) and all(len(v) == 1 for v in by_key.values())


def test_no_clash_keeps_the_hash(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").withColumn("d", row_digest(F.col("doc_id"), F.col("text")))
    got = {r["doc_id"]: r["k"] for r in with_unique_keys(df, "d", "k").collect()}
    want = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("d").alias("h")).collect()}
    assert got == want
    assert with_unique_keys(df.limit(0), "d", "k").count() == 0


def test_digest_tells_null_from_empty(spark):
    df = spark.createDataFrame([(None, ""), (None, None), (0, None), (0, "")], "doc_id long, text string")
    assert df.select(row_digest(F.col("doc_id"), F.col("text"))).distinct().count() == 4
