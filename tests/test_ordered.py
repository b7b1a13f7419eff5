import pytest
from pyspark.sql import functions as F

from logloom.operators import ordered as o
from logloom.operators.rules import RuleError


@pytest.fixture(scope="module")
def df(logs):
    """Two sources, interleaved; the larger one has gaps in seq."""
    return logs([dict(source="ab"[i % 5 == 0], seq=i * 3 if i % 2 else i * 3 + 1, message=f"m{i}") for i in range(60)])


def model(df):
    groups = {}
    for r in sorted(df.collect(), key=lambda r: r["seq"]):
        groups.setdefault(r["source"], []).append(r["seq"])
    return groups


@pytest.mark.parametrize("tasks", [1, 3, 11])
def test_row_numbers(spark, df, tasks):
    """However few rows a task has; coalescing is off, so that each has some."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {(r["source"], r["seq"]): r["n"] for r in o.with_row_number(df, "n").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(s, q): i for s, seqs in model(df).items() for i, q in enumerate(seqs, 1)}


def test_row_numbers_gather_a_row_per_task_and_source(df):
    plan = o.with_row_number(df, "n")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "windowspec" in line]
    assert windows and all("_rows" in line for line in windows)


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_tail(df, n):
    got = sorted((r["source"], r["seq"]) for r in o.tail_logs(df, n).collect())
    assert got == sorted((s, q) for s, seqs in model(df).items() for q in (seqs[-n:] if n else []))


def test_backfill_zero_keeps_all(df):
    assert o.backfill_logs(df, 0).count() == 60 and o.backfill_logs(df, 2).count() == 4
    with pytest.raises(RuleError):
        o.backfill_logs(df, -1)


def test_every_third_of_ten(logs):
    rows = o.sample_nth(logs([dict(message=f"msg-{i}") for i in range(10)]), 3)
    assert sorted(r["message"] for r in rows.collect()) == ["msg-2", "msg-5", "msg-8"]
    assert o.sample_nth(rows, 1).count() == 3


def test_rate_sample_is_repeatable_and_near_its_rate(spark, logs):
    df = spark.range(20_000).select(F.lit("s").alias("source"), F.col("id").alias("seq"))
    a, b = ({r["seq"] for r in o.sample_rate(df.repartition(k), 0.3, seed=9).collect()} for k in (2, 5))
    assert a == b and abs(len(a) / 20_000 - 0.3) < 0.02
    other = {r["seq"] for r in o.sample_rate(df, 0.3, seed=10).collect()}
    assert abs(len(a & other) / 20_000 - 0.09) < 0.02
    assert o.sample_rate(df, 1.0).count() == 20_000
    both = {r["seq"] for r in o.sample_logs(df, 10, 0.3, seed=9).collect()}
    assert both <= {i for i in range(9, 20_000, 10)} & a


@pytest.mark.parametrize("bad", [dict(every_nth=0), dict(rate=0.0), dict(rate=1.5)])
def test_bad_samples(df, bad):
    with pytest.raises(RuleError):
        o.sample_logs(df, **bad)


def test_sort(logs):
    df = logs([dict(timestamp="2024-01-01T00:00:02Z"), dict(timestamp="2024-01-01T00:00:01Z"), dict(), dict(timestamp="2024-01-01T00:00:01Z")])
    assert [r["seq"] for r in o.sort_logs(df).collect()] == [2, 1, 3, 0]
