import pytest
from pyspark.sql import functions as F

from logloom.llm import urls

RULES = [urls.UrlRule("net", "/", "block"), urls.UrlRule("example.net", "/en/", "allow"), urls.UrlRule("example.com", "/de/", "block")]
CASES = [
    ("http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("https://example.net/EN/x", "example.net", "/EN/x", "net/", "block"),
    ("https://example.net", "example.net", "", None, "allow"),
    ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("https://www.example.com/de/?a://b", "www.example.com", "/de/", "example.com/de/", "block"),
    ("x?u=http://q.net/a", "q.net", "/a", "net/", "block"),
    ("//example.net/en/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("http://É.org#f/g", "É.org", "", None, "allow"),
    ("http://bad.org/p/?q", "bad.org", "/p/", None, "block"),
    ("ftp://WWW.bad.org:80/p", "www.bad.org:80", "/p", None, "block"),
    ("http://bad.org/p\n/q", "bad.org", "/p\n/q", None, "allow"),
    ("http://bad.org/" + "a" * 50_000, "bad.org", "/" + "a" * 50_000, None, "allow"),
]


@pytest.mark.parametrize("max_blocks", [1, 1 << 18])
def test_verdicts(spark, max_blocks):
    rows = [(i, c[0], "x", "y", "z") for i, c in enumerate(CASES)] + [(0, CASES[0][0], "x", "y", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, canonical string, maybe string")
    # Enough entries to fill one block, so that every probe passes and the join decides.
    listed = spark.createDataFrame([("http://bad.org/p",), (None,), ("none",), *((f"http://l{i}.org/",) for i in range(3000))], "url string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, listed, RULES).collect())
    assert got == sorted((r[0], *CASES[r[0]][1:]) for r in rows)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    entries = spark.range(20_000).select(F.concat(F.lit("h"), "id", F.lit("/")).alias("canonical"))
    table = urls.bloom_blocks(entries)
    bits = sum(bin(int(w)).count("1") for w in table.reshape(-1))
    assert table.shape == (512, 8) and bits / table.size / 64 < 0.5


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(none, none, RULES).count() == 0
    one = spark.createDataFrame([(None, "http://a.b/")], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge_urls(one, none, []).collect()] == ["allow"]
