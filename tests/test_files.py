import csv
import gzip
import io
import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logloom.operators.rules import Route, RuleError, SplitRule
from logloom.sinks import files as k
from logloom.sources.files import read_lines, read_logs, replay_logs, stream_logs

CONTENT = '{"level":"info","msg":"one"}\n\n{"level":"error","msg":"two"}\nplain three\n'


@pytest.fixture
def feed(tmp_path):
    (tmp_path / "web.log").write_text(CONTENT)
    with gzip.open(tmp_path / "db.log.gz", "wb") as out:
        out.write(CONTENT.encode() + b"bad \xff byte\n")
    return tmp_path


def test_plain_and_gzip_files(spark, feed):
    rows = read_logs(spark, str(feed)).orderBy("source", "seq").collect()
    assert [(r["source"], r["message"]) for r in rows] == [
        ("db", "one"), ("db", "two"), ("db", "plain three"), ("db", "bad � byte"),
        ("web", "one"), ("web", "two"), ("web", "plain three"),
    ]
    found = replay_logs(spark, str(feed / "web.log"), F.col("level") == "error").collect()
    assert [r["message"] for r in found] == ["two"]


def test_missing_path(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_logs(spark, str(tmp_path / "none.log"))


def test_line_order_over_many_splits_and_files(spark, tmp_path):
    for name in ("a", "b", "tiny"):
        (tmp_path / f"{name}.log").write_text("".join(f"{name} line {i}\n" for i in range(30 if name == "tiny" else 20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        lines = read_lines(spark, str(tmp_path)).collect()
        assert len({(r["source"], r["seq"]) for r in lines}) == 40_030
        for name, n in (("a", 20_000), ("b", 20_000), ("tiny", 30)):
            mine = sorted((r["seq"], r["raw"]) for r in lines if r["source"] == name)
            assert [raw for _, raw in mine] == [f"{name} line {i}" for i in range(n)]
        feed = sorted((r["seq"], r["raw"]) for r in read_lines(spark, str(tmp_path), source="feed").collect())
        assert [raw.split()[0] for _, raw in feed] == ["a"] * 20_000 + ["b"] * 20_000 + ["tiny"] * 30
        tail = read_lines(spark, str(tmp_path), tail=3).orderBy("source", "seq").collect()
        assert [r["raw"] for r in tail][:3] == [f"a line {i}" for i in (19_997, 19_998, 19_999)] and len(tail) == 9
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def text_of(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def test_exports(logs, tmp_path):
    df = logs(
        [
            dict(timestamp="2024-01-01T00:00:00Z", level="error", message='say "hi", now', raw="r1"),
            dict(message=" padded ", raw="#r2"),
            dict(message="two\nlines", raw="r3", level="verylonglevel"),
        ]
    ).coalesce(1)
    k.write_logs(df, f"{tmp_path}/j", "json")
    records = [json.loads(line) for line in text_of(f"{tmp_path}/j").splitlines()]
    assert records[1] == {"timestamp": None, "level": None, "message": " padded ", "raw": "#r2"}
    k.write_logs(df, f"{tmp_path}/c", "csv")
    rows = list(csv.DictReader(io.StringIO(text_of(f"{tmp_path}/c"))))
    assert rows[0] == {"timestamp": "2024-01-01T00:00:00Z", "level": "error", "message": 'say "hi", now', "raw": "r1"}
    assert rows[1] == {"timestamp": "", "level": "", "message": " padded ", "raw": "#r2"}
    assert rows[2]["message"] == "two\nlines"
    k.write_logs(df, f"{tmp_path}/t", "text")
    assert text_of(f"{tmp_path}/t").splitlines()[:2] == ['[2024-01-01T00:00:00Z] say "hi", now', " padded "]
    k.write_logs(df, f"{tmp_path}/p", "plain")
    plain = text_of(f"{tmp_path}/p").splitlines()
    assert plain[0] == '2024-01-01T00:00:00Z  ERROR    say "hi", now'
    assert plain[1] == "  UNKNOWN   padded " and plain[2] == "  VERYLONGLEVEL  two"
    with pytest.raises(RuleError):
        k.write_logs(df, f"{tmp_path}/x", "xml")
    k.write_json_array(df, f"{tmp_path}/a")
    assert [r["raw"] for r in json.loads(text_of(f"{tmp_path}/a"))] == ["r1", "#r2", "r3"]
    k.write_json_array(df.limit(0), f"{tmp_path}/e")
    assert json.loads(text_of(f"{tmp_path}/e")) == []


def test_rotated_files_come_oldest_first(spark, tmp_path):
    texts = {"app.log": "new", "app.log.1": "mid", "app.log.2.gz": "old", "app.log.10": "older", "app.log.11.gz": "oldest", "web.log": "w"}
    for name, text in texts.items():
        data = f"{text}1\n{text}2\n".encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    rows = read_lines(spark, str(tmp_path)).orderBy("source", "seq").collect()
    assert [r["raw"] for r in rows if r["source"] == "app"] == [f"{t}{i}" for t in ("oldest", "older", "old", "mid", "new") for i in (1, 2)]
    kept = read_lines(spark, str(tmp_path), tail=3).where("source = 'app'").orderBy("seq").collect()
    assert [r["raw"] for r in kept] == ["mid2", "new1", "new2"]


def test_split_and_routes(spark, logs, tmp_path):
    df = logs([dict(level="e"), dict(level="i"), dict(level="e")])
    k.write_split(df, [SplitRule("errors", "level = 'e'"), SplitRule("never", "false")], f"{tmp_path}/s")
    assert sorted(p.name for p in (tmp_path / "s").glob("bucket=*")) == ["bucket=default", "bucket=errors"]
    k.write_routes(df, [Route("errors", "level = 'e'"), Route("all", "true")], f"{tmp_path}/r")
    counts = spark.read.parquet(f"{tmp_path}/r").groupBy("route").count().collect()
    assert {r["route"]: r["count"] for r in counts} == {"errors": 2, "all": 3}


def test_tee(logs):
    df = logs([dict(message="m")])
    seen = []

    def bad(_):
        raise ValueError("boom")

    sinks = {"bad": bad, "good": lambda d: seen.append(d.count()), "worse": bad}
    with pytest.raises(k.SinkError, match="bad.*boom"):
        k.tee_logs(df, sinks)
    assert seen == []
    with pytest.raises(k.SinkError, match="'bad': boom; 'worse': boom"):
        k.tee_logs(df, sinks, fail_fast=False)
    assert seen == [1]
    for wrong in ({}, {" ": bad}, {"x": None}):
        with pytest.raises(RuleError):
            k.tee_logs(df, wrong)


def test_dispatch_routes(logs):
    df = logs([dict(level="e"), dict(level="i")])
    seen = {}
    routes = [
        Route("e", "level = 'e'", True, lambda d: seen.update(e=[r["seq"] for r in d.collect()])),
        Route("rest", "true", sink=lambda d: seen.update(rest=[r["seq"] for r in d.collect()])),
    ]
    k.dispatch_routes(df, routes)
    assert seen == {"e": [0], "rest": [1]}


def test_followed_files(spark, feed, tmp_path):
    target = tmp_path / "out"
    query = (
        stream_logs(spark, str(feed / "*log*"))
        .select("source", "seq", "message")
        .writeStream.option("checkpointLocation", f"{tmp_path}/cp")
        .trigger(availableNow=True)
        .start(str(target))
    )
    query.awaitTermination()
    got = spark.read.parquet(str(target)).orderBy("source", "seq").collect()
    assert [r["message"] for r in got if r["source"] == "web"] == ["one", "two", "plain three"]
    assert len({(r["source"], r["seq"]) for r in got}) == len(got)
