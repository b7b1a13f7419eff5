import pytest
from pyspark.sql import functions as F

from logloom.operators import filters as f
from logloom.operators.parse import parse_logs

RAWS = [
    "2024-01-15T12:00:00.0Z Starting database connection",
    '2024-01-15T12:00:01.0Z {"level":"error","msg":"Database timeout"}',
    '2024-01-15T12:00:02.0Z {"severity":"ERROR","msg":"disk full"}',
    '2024-01-15T12:00:03.0Z {"level":null,"severity":"error","msg":"odd"}',
    "request completed 100% of a_b",
]


@pytest.fixture(scope="module")
def parsed(lines):
    return parse_logs(lines(RAWS)).cache()


def seqs(df):
    return sorted(r["seq"] for r in df.select("seq").collect())


def test_exact(parsed):
    assert seqs(f.exact_filter(parsed, "DATABASE")) == [0, 1]
    assert seqs(f.exact_filter(parsed, "100% of a_b")) == [4]
    assert seqs(f.exact_filter(parsed, "a%b")) == []


def test_level_of_payload(parsed):
    assert seqs(f.level_filter(parsed, "Error")) == [1, 2]
    assert seqs(f.level_equals(parsed, "ERROR")) == [1, 2]


def test_since_and_predicates(parsed):
    assert seqs(f.since_filter(parsed, "2024-01-15 12:00:02")) == [2, 3]
    assert seqs(f.predicate_filter(parsed, "level = 'error'")) == [1]
    assert seqs(f.predicate_filter(parsed, F.col("is_json"))) == [1, 2, 3]


def test_chain(parsed):
    assert seqs(f.filter_logs(parsed)) == [0, 1, 2, 3, 4]
    assert seqs(f.filter_logs(parsed, "databse", fuzzy=True)) == [0, 1]
    assert seqs(f.filter_logs(parsed, "databse", fuzzy=True, level="error")) == [1]
    assert seqs(f.filter_logs(parsed, "databse")) == []


def test_level_test_runs_before_the_fuzzy_score(parsed):
    plan = f.filter_logs(parsed, "databse", fuzzy=True, level="error")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("Filter")


def test_null_messages_do_not_match(logs):
    df = logs([dict(message=None), dict(message="abc")])
    assert seqs(f.exact_filter(df, "abc")) == [1]
    assert seqs(f.fuzzy_filter(df, "abx", 60)) == [1]
