import pytest
from pyspark.sql import functions as F

from logloom.operators import tag
from logloom.operators.rules import (
    AlertRule,
    AnnotationRule,
    ClassifyRule,
    EnrichRule,
    LabelRule,
    Route,
    RuleError,
    ScoreRule,
    SplitRule,
)


@pytest.fixture(scope="module")
def df(logs):
    return logs(
        [
            dict(message="disk timeout", level="ERROR", extra={"k": "old"}),
            dict(message="login ok", level="info"),
            dict(message="timeout again", level=None, source="d"),
        ]
    )


def by_seq(frame, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in frame.orderBy("seq").collect()]


def test_annotate_later_rules_win(df):
    rules = [
        AnnotationRule("k", "message like '%timeout%'", "first"),
        AnnotationRule("k", F.col("level") == "ERROR", "second"),
        AnnotationRule("seen", "true"),
        AnnotationRule("none", "level = 'x'"),
    ]
    assert by_seq(tag.annotate_logs(df, rules), "extra") == [
        {"k": "second", "seen": "true"},
        {"seen": "true"},
        {"k": "first", "seen": "true"},
    ]
    assert by_seq(tag.annotate_logs(df, []), "extra") == by_seq(df, "extra")


def test_label(df):
    rules = [LabelRule("a", "true", {"k": "1", "b": "2"}), LabelRule("b", "level = 'info'", {"k": "3"})]
    assert by_seq(tag.label_logs(df, rules), "extra")[:2] == [{"k": "1", "b": "2"}, {"k": "3", "b": "2"}]


def test_enrich_rules_see_earlier_ones(df):
    rules = [tag.host_rule(), EnrichRule("n", F.length("message")), EnrichRule("both", "concat(extra['host'], extra['n'])")]
    assert by_seq(tag.enrich_logs(df, rules), "extra")[0] == {"k": "old", "host": "c", "n": "12", "both": "c12"}


def test_index_counts_per_source(df):
    assert [e["index"] for e in by_seq(tag.add_index(df), "extra")] == ["1", "2", "1"]


def test_classify_first_match_and_skipped_failures(df):
    rules = [
        ClassifyRule("bad", "try_divide(1, 0) > 0", "never"),
        ClassifyRule("t", "contains(message, 'timeout')", "slow"),
        ClassifyRule("e", "level = 'ERROR'", "error"),
    ]
    assert by_seq(tag.classify_logs(df, rules), "category") == ["slow", "uncategorized", "slow"]
    assert by_seq(tag.classify_logs(df, [], "other"), "category") == ["other"] * 3


def test_split(df):
    rules = [SplitRule("error", "lower(level) = 'error'"), SplitRule("t", "contains(message, 'timeout')")]
    assert by_seq(tag.split_logs(df, rules), "bucket") == ["error", "default", "t"]


def test_routes_and_stop(df):
    routes = [Route("t", "contains(message, 'timeout')", stop=True), Route("all", "true"), Route("e", "level = 'ERROR'")]
    assert by_seq(tag.route_logs(df, routes), "routes") == [["t"], ["all"], ["t"]]
    open_routes = [Route("t", "contains(message, 'timeout')"), Route("all", "true"), Route("e", "level = 'ERROR'")]
    assert by_seq(tag.route_logs(df, open_routes), "routes") == [["t", "all", "e"], ["all"], ["t", "all"]]
    assert by_seq(tag.route_logs(df, []), "routes") == [[], [], []]
    assert tag.explode_routes(df, open_routes).count() == 6


def test_score_and_rank(df):
    rules = [ScoreRule("t", "contains(message, 'timeout')", 2), ScoreRule("e", "level = 'ERROR'", -0.5)]
    assert by_seq(tag.score_logs(df, rules), "score") == [1.5, 0.0, 2.0]
    assert [r["seq"] for r in tag.rank_logs(df, rules).collect()] == [2, 0, 1]
    assert [r["seq"] for r in tag.rank_logs(df, [ScoreRule("x", "true", 1)], 2).collect()] == [0, 1]


def test_shorthands(df):
    rules = [tag.annotation_from_spec(" slow :TimeOut"), tag.annotation_from_spec("x:a:b")]
    assert by_seq(tag.annotate_logs(df, rules), "extra")[0] == {"k": "old", "slow": "TimeOut"}
    assert by_seq(tag.classify_logs(df, [tag.category_from_spec("auth: LOGIN ")]), "category")[1] == "auth"
    routes = [tag.keyword_route("kw:TIME"), tag.level_route("lv:error")]
    assert by_seq(tag.route_logs(df, routes), "routes") == [["kw", "lv"], [], ["kw"]]
    for bad in (tag.annotation_from_spec, tag.category_from_spec, tag.keyword_route, tag.level_route):
        with pytest.raises(RuleError):
            bad("nocolon")


@pytest.mark.parametrize(
    "build",
    [
        lambda: AnnotationRule("", "true"),
        lambda: AnnotationRule("t", None),
        lambda: LabelRule("", "true", {"a": "b"}),
        lambda: LabelRule("n", "true", {}),
        lambda: LabelRule("n", "true", {"": "b"}),
        lambda: LabelRule("n", "true", {"a": 1}),
        lambda: LabelRule("n", 3, {"a": "b"}),
        lambda: EnrichRule("", "1"),
        lambda: EnrichRule("k", 5),
        lambda: ClassifyRule("", "true", "c"),
        lambda: ClassifyRule("n", "true", ""),
        lambda: SplitRule("  ", "true"),
        lambda: SplitRule("n", None),
        lambda: Route("", "true"),
        lambda: Route("n", "true", sink=3),
        lambda: ScoreRule("", "true", 1),
        lambda: ScoreRule("n", "true", 0),
        lambda: AlertRule("", threshold=1),
        lambda: AlertRule("e", threshold=0),
        lambda: AlertRule("e", window=-1),
    ],
)
def test_bad_rules(build):
    with pytest.raises(RuleError):
        build()
