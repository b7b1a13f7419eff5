"""Exact boundary cases of the sequential operators."""

import pytest
from pyspark.sql import functions as F

from logloom.operators import stateful as s
from logloom.operators.rules import AlertRule, RuleError


def at(second, **columns):
    whole, milli = divmod(round(second * 1000), 1000)
    minutes, seconds = divmod(whole, 60)
    return dict(timestamp=f"2024-01-01T12:{minutes:02d}:{seconds:02d}.{milli:03d}Z", **columns)


def seqs(df):
    return sorted(r["seq"] for r in df.select("seq").collect())


def test_throttle_boundaries(logs):
    df = logs([at(0, message="x"), at(10, message="x"), at(10.001, message="x"), at(10, message="y")])
    assert seqs(s.throttle_logs(df, 10)) == [0, 2, 3]
    df = logs([at(i, message="x") for i in range(4)])
    assert seqs(s.throttle_logs(df, 60, 3)) == [0, 1, 2]
    df = logs([at(0, service="a", message="1"), at(1, service="a", message="2"), at(1, service="b", message="3")])
    assert seqs(s.throttle_logs(df, 60, key=F.col("service"))) == [0, 2]


def test_rows_without_time_pass(logs):
    df = logs([at(0, message="x"), dict(message="x"), at(1, message="x")])
    assert seqs(s.throttle_logs(df, 60)) == [0, 1]
    assert seqs(s.rate_limit_logs(df, 1)) == [0, 1, 2][:2]


def test_rate_limit(logs):
    df = logs([at(0), at(0), at(0), at(1), at(1.1)])
    assert seqs(s.rate_limit_logs(df, 2)) == [0, 1, 4]
    assert seqs(s.rate_limit_logs(df, 1.5)) == [0, 1, 4]


def test_alerts(logs):
    df = logs([at(i, level="ERROR", message="disk full") for i in range(2)] + [at(2, level=None), at(3, level="error", message="x")])
    assert seqs(s.alert_logs(df, [AlertRule("error", threshold=2)])) == [1]
    assert seqs(s.alert_logs(df, [AlertRule("Error")])) == [0, 1, 3]
    rules = [AlertRule("error", "DISK", name="a"), AlertRule("error", threshold=3, window=0, name="b")]
    got = {(r["rule"], r["seq"]) for r in s.alert_logs(df, rules).collect()}
    assert got == {("a", 0), ("a", 1), ("b", 3)}
    edge = logs([at(0, level="e"), at(5, level="e"), at(11, level="e")])
    assert seqs(s.alert_logs(edge, [AlertRule("e", threshold=2, window=5)])) == [1]
    with pytest.raises(RuleError):
        s.alert_logs(df, [])


def test_anchored_windows(logs):
    df = logs([at(11 * i, level="INFO" if i else "") for i in range(5)])
    windowed = s.anchored_windows(df, 10)
    assert windowed.select("window_start").distinct().count() == 5
    one = s.window_summaries(s.anchored_windows(df, 44)).orderBy("window_id").collect()
    assert [(r["window_id"], r["total"]) for r in one] == [(1, 4), (2, 1)]
    assert one[0]["levels"] == {"info": 3, "unknown": 1}
    late = logs([at(20), at(5), at(29.999), at(30), at(22)])
    groups = s.anchored_windows(late, 10).groupBy("window_start").count().orderBy("window_start").collect()
    assert [r["count"] for r in groups] == [3, 2]
    assert s.anchored_windows(logs([dict(), at(1)]), 10, null_ts="now").count() == 2
    with pytest.raises(RuleError):
        s.anchored_windows(df, 0)


def test_dedup(logs):
    df = logs([dict(message=m) for m in ["x", " x ", "y", "x", "y"]])
    assert seqs(s.dedup_logs(df)) == [0, 2]
    five = logs([dict(message="m")] * 5)
    assert seqs(s.dedup_logs(five, max_repeats=3)) == [0, 1, 2]
    assert seqs(s.dedup_logs(five, max_repeats=1001)) == [0, 1, 2, 3, 4]
    report = s.suppressed_logs(logs([dict(message="m")] * 3), max_repeats=1).orderBy("seq").collect()
    assert [r["occurrence"] for r in report] == [2, 3]
    evicted = logs([dict(message=f"msg-{i % 4}") for i in range(5)])
    assert seqs(s.dedup_logs(evicted, window_size=3)) == [0, 1, 2, 3, 4]
    assert seqs(s.dedup_logs(logs([dict(message=None), dict(message="")]))) == [0]
    for bad in (dict(window_size=0), dict(max_repeats=0)):
        with pytest.raises(RuleError):
            s.dedup_logs(df, **bad)


def test_sequence(logs):
    df = logs([at(t) for t in (2, 1, 3)] + [dict()])
    order = [r["seq"] for r in s.sequence_logs(df, 10).orderBy("position").collect()]
    assert order == [3, 1, 0, 2]
    order = [r["seq"] for r in s.sequence_logs(df, 2).orderBy("position").collect()]
    assert order == [1, 3, 0, 2]
    with pytest.raises(RuleError):
        s.sequence_logs(df, 0)


@pytest.mark.parametrize("width,limit", [(0, 1), (-1, 1), (1, 0)])
def test_bad_throttles(logs, width, limit):
    with pytest.raises(RuleError):
        s.throttle_logs(logs([dict()]), width, limit)


def test_bad_rate(logs):
    with pytest.raises(RuleError):
        s.rate_limit_logs(logs([dict()]), 0)


def test_empty_input(logs):
    empty = logs([at(0, level="e")]).where("false")
    assert s.throttle_logs(empty, 1).count() == s.dedup_logs(empty).count() == s.sequence_logs(empty).count() == 0
