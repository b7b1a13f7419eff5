import pytest
from pyspark.sql import functions as F

from logloom.operators import aggregate as a
from logloom.operators.rules import RuleError


def at(second, **columns):
    minutes, seconds = divmod(second, 60)
    return dict(timestamp=f"2024-01-01T12:{minutes:02d}:{seconds:02d}Z", **columns)


def test_tumbling_windows(logs):
    df = logs(
        [
            at(10, level="INFO", service="api"),
            at(50, level="info", service="API"),
            at(70, level=None, service=""),
            dict(level="info"),
        ]
    )
    rows = a.tumbling_counts(df, 60).orderBy("window_start").withColumn("line", a.bucket_line()).collect()
    assert [(r["total"], r["window_start"] is None) for r in rows] == [(1, True), (2, False), (1, False)]
    assert a.tumbling_counts(df, 60, null_ts="drop").count() == 2
    rows = rows[1:]
    assert rows[0]["by_level"] == {"info": 2} and rows[0]["by_service"] == {"API": 1, "api": 1}
    assert rows[1]["by_level"] == {"unknown": 1} and rows[1]["by_service"] == {"unknown": 1}
    assert rows[0]["line"] == "[12:00:00-12:01:00] total=2 levels=(info=2)"
    assert a.tumbling_counts(df, 60, null_ts="now").agg(F.sum("total")).collect()[0][0] == 4
    for bad in (0, -5):
        with pytest.raises(RuleError):
            a.tumbling_counts(df, bad)


def test_windows_align_to_the_epoch_also_before_it(logs):
    df = logs([dict(timestamp="1969-12-31T23:59:58Z"), dict(timestamp="1970-01-01T00:00:03Z")])
    rows = a.tumbling_counts(df, 7).orderBy("window_start").select(F.unix_seconds("window_start")).collect()
    assert [r[0] for r in rows] == [-7, 0]


def test_stats(logs):
    df = logs(
        [
            at(1, level="info", message="a", extra={"service": "web"}),
            at(2, level="INFO", message="a", extra={"container": "box"}),
            at(3, level="error", message="b", extra={"service": "", "container": "box"}),
            dict(level="debug", message="", extra={}),
            dict(level="warning", message="x" * 130),
            dict(level="warning", message="x" * 125),
            dict(source="other", level=None, message="b"),
        ]
    )
    rows = {r["source"]: r for r in a.stats(df).collect()}
    assert rows["c"]["total"] == 6
    assert rows["c"]["by_level"] == {"info": 2, "error": 1, "debug": 1, "warning": 2}
    assert rows["c"]["by_service"] == {"web": 1, "box": 2, "unknown": 3}
    assert (rows["c"]["last_ts"] - rows["c"]["first_ts"]).seconds == 2
    assert rows["other"]["by_level"] == {"unknown": 1} and rows["other"]["first_ts"] is None
    assert a.stats(df, by=()).collect()[0]["total"] == 7
    top = [(r["message"], r["count"]) for r in a.top_messages(df, 3, by=()).collect()]
    assert top == [("a", 2), ("b", 2), ("x" * 120, 2)]
    per_source = {(r["source"], r["message"]) for r in a.top_messages(df, 1).collect()}
    assert per_source == {("c", "a"), ("other", "b")}
    levels = [(r["level"], r["count"]) for r in a.level_breakdown(df, by=(), top=2).collect()]
    assert levels == [("info", 2), ("warning", 2)]


def test_correlation_keys_and_groups(logs):
    df = logs(
        [
            at(0, level="Info", service="b", extra={"trace_id": "t1"}),
            at(1, level=None, service="a", extra={"trace_id": "t1"}),
            at(0, level="error"),
            at(11, level="error"),
            dict(level="x"),
            dict(extra={"trace_id": None}),
        ]
    )
    groups = {r["key"]: r for r in a.correlation_groups(df, window_seconds=10).collect()}
    assert len(groups) == 5 and "ungrouped" in groups and "None" in groups
    assert groups["t1"]["count"] == 2 and groups["t1"]["levels"] == {"Info": 1, "unknown": 1}
    assert groups["t1"]["services"] == ["a", "b"] and groups["ungrouped"]["services"] == []
    assert [r["key"] for r in a.correlation_groups(df, window_seconds=10, min_group_size=2).collect()] == ["t1"]
    assert a.correlated_rows(df, window_seconds=10, min_group_size=2).count() == 2
    before = logs([dict(timestamp="1969-12-31T23:59:57Z")])
    assert a.correlation_groups(before, window_seconds=5).collect()[0]["key"] == "window:0"
    for bad in (dict(window_seconds=0), dict(min_group_size=0)):
        with pytest.raises(RuleError):
            a.correlation_groups(df, **bad)


def test_counts(logs):
    df = logs([dict(level="a"), dict(level="b"), dict(level="a")])
    assert [tuple(r) for r in a.bucket_counts(df, "level").collect()] == [("a", 2), ("b", 1)]
    assert a.match_count(df).collect()[0]["matched"] == 3


def test_hot_groups_are_counted_before_the_shuffle(logs):
    df = logs([at(1, level="x")])
    for frame in (a.tumbling_counts(df), a.stats(df), a.correlation_groups(df), a.top_messages(df)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "partial_count" in plan and plan.rindex("partial_count") > plan.rindex("Exchange")
