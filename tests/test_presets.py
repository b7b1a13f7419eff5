import pytest

from logloom.operators.rules import RuleError
from logloom.plans import presets as p

TS = "2024-01-15T12:00:0{}.0Z"
RAWS = [
    TS.format(0) + ' {"level":"info","service":"api","msg":"started port 80","trace_id":"t1"}',
    TS.format(1) + ' {"level":"error","service":"api","msg":"db timeout","trace_id":"t1"}',
    TS.format(2) + " plain timeout password=hunter2",
    TS.format(3) + ' {"level":"error","service":"db","msg":"db timeout"}',
    "",
]


@pytest.fixture(scope="module")
def raw(lines):
    return lines(RAWS)


def column(df, name="line", order=("seq",)):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_browse_export_replay(raw):
    assert column(p.browse(raw, level="error")) == [
        "2024-01-15T12:00:01.0Z  ERROR    db timeout",
        "2024-01-15T12:00:03.0Z  ERROR    db timeout",
    ]
    assert column(p.browse(raw, search="TIMEOUT", mark=True))[1].endswith("plain <mark>timeout</mark> password=hunter2")
    assert column(p.export(raw, search="started"), "message") == ["started port 80"]
    assert column(p.replay(raw, search="timeotu")) == [
        "[2024-01-15T12:00:01.0Z] db timeout",
        "[2024-01-15T12:00:02.0Z] plain timeout password=hunter2",
        "[2024-01-15T12:00:03.0Z] db timeout",
    ]
    assert p.replay(raw, exact="db").count() == 2


def test_tail_counts_raw_lines_before_parsing_and_filtering(raw):
    assert p.browse(raw, tail=2).count() == 1
    assert p.browse(raw, tail=3, level="info").count() == 0


def test_stats_and_aggregate(raw):
    row = p.stats(raw).collect()[0]
    assert row["by_level"] == {"info": 1, "error": 2, "unknown": 1} and row["by_service"] == {"api": 2, "db": 1, "unknown": 1}
    assert column(p.aggregate_windows(raw), order=("window_start",)) == [
        "[12:00:00-12:01:00] total=4 levels=(error=2, info=1, unknown=1)"
    ]
    top = {tuple(r)[1:] for r in p.stats_top(raw, top=1).collect()}
    assert top == {("level", "error", 2), ("service", "api", 2)}
    assert {r["kind"] for r in p.stats_top(raw, service=False).collect()} == {"level"}
    with pytest.raises(RuleError):
        p.stats_top(raw, level=False, service=False)
    assert [tuple(r)[1:] for r in p.top_messages(raw, top=1).collect()] == [("db timeout", 2)]


def test_alert_sample_dedup_sequence_rate_limit_tail(raw):
    assert column(p.alert(raw, threshold=2), "seq") == [3]
    assert column(p.sample(raw, every_nth=2), "seq") == [1, 3]
    assert column(p.dedup(raw, level="error"), "seq") == [1]
    assert [(r["seq"], r["occurrence"]) for r in p.dedup_report(raw, level="error").collect()] == [(3, 2)]
    assert column(p.replay(raw, exact="started", plain=True)) == ["2024-01-15T12:00:00.0Z  INFO     started port 80"]
    assert column(p.sequence(raw), "seq") == [0, 1, 2, 3]
    assert column(p.rate_limit(raw, 1), "seq") == [0, 2]
    assert column(p.tail(raw, 3, search="timeotu"), "seq") == [2, 3]
    assert p.tail(raw).count() == 4


def test_transform(raw):
    rows = p.transform(raw, [r"password=\S+"], ["message:db:database", "level:^err:E:rr", "service:api:svc"]).orderBy("seq").collect()
    assert rows[2]["message"] == "plain timeout [REDACTED]"
    assert rows[1]["message"] == "database timeout" and rows[1]["level"] == "E:rror" and rows[0]["service"] == "svc"
    with pytest.raises(RuleError):
        p.transform(raw, replace=["message:only"])


def test_correlate(raw):
    groups = p.correlate(raw).orderBy("key").collect()
    assert [(g["key"], g["count"], g["services"]) for g in groups] == [("t1", 2, ["api"]), ("window:341064000", 2, ["db"])]


def test_annotate_shows_tags(raw):
    assert column(p.annotate(raw, ["slow:TimeOut"]))[2] == (
        "2024-01-15T12:00:02.0Z  UNKNOWN  plain timeout password=hunter2 [slow=TimeOut]"
    )
    assert p.annotate(raw, ["x:y"], level="error").count() == 2


def test_route_and_split(raw):
    assert column(p.route(raw, ["to:timeout"], ["bad:error"]), order=("seq", "route"))[:2] == [
        "[bad] 2024-01-15T12:00:01.0Z  ERROR    db timeout",
        "[to] 2024-01-15T12:00:01.0Z  ERROR    db timeout",
    ]
    assert p.route(raw, ["to:timeout"], ["bad:error"], stop=True).count() == 3
    assert column(p.split(raw, ["ERROR"], ["TimeOut"]), "bucket") == ["default", "error", "timeout", "error"]


def test_enrich_mask_classify(raw):
    rows = p.enrich(raw, add_index=True, level="error").orderBy("seq").collect()
    assert [(r["extra"]["host"], r["extra"]["index"]) for r in rows] == [("c", "1"), ("c", "2")]
    masked = p.mask(raw, ["message", "trace_id"]).orderBy("seq").collect()
    assert masked[0]["line"].endswith("***") and masked[0]["extra"]["trace_id"] == "***" and masked[0]["raw"] is None
    assert column(p.classify(raw, ["slow:timeout"]))[:2] == [
        "[uncategorized] [2024-01-15T12:00:00.0Z] started port 80",
        "[slow] [2024-01-15T12:00:01.0Z] db timeout",
    ]
