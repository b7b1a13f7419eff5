"""Streams cut into micro-batches, run to their end, against the batch operators."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logloom.operators import aggregate, stateful
from logloom.operators.rules import AlertRule
from logloom.schema import LOG_SCHEMA
from logloom.streaming import operators as st

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def table(spark, logs, tmp_path_factory):
    """The same rows as a batch frame and as ten files, each one micro-batch; times stray by less than the delay."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        ts = BASE + timedelta(seconds=round(i * 0.7 + rng.uniform(0, 10), 2))
        rows.append(
            dict(source=rng.choice("aab"), seq=i, ts=None if i % 13 == 5 else ts, level=rng.choice(["error", "info"]), service="s",
                 message=f"m{rng.randrange(4)}", extra={"k": str(i)}, structured={"n": None})
        )
    path = tmp_path_factory.mktemp("stream")
    for part in range(10):
        logs(rows[part * 30 : part * 30 + 30]).coalesce(1).write.mode("append").parquet(str(path))
    return logs(rows), str(path), rows


def run(spark, table, operator, tmp_path, closed=True):
    source = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(table[1])
    end = f"{tmp_path}/end"
    out = operator(st.closable(source, end))
    queries = []

    def start():
        writer = out.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        queries.append(writer.start(f"{tmp_path}/out"))
        return queries[-1]

    if closed:
        st.run_closed(out, start, end, LOG_SCHEMA)
    else:
        start().awaitTermination()
    assert len(queries[0].recentProgress) >= 10
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")


def ids(df):
    return sorted((r["source"], r["seq"]) for r in df.select("source", "seq").collect())


def test_throttle_and_rate_limit(spark, table, tmp_path):
    batch = table[0]
    got = run(spark, table, lambda s: st.throttle_stream(s, 5, 1, delay="30 seconds"), tmp_path / "t")
    assert ids(got) == ids(stateful.throttle_logs(batch, 5, 1))
    assert got.where("extra['k'] <> cast(seq as string)").count() == 0 and got.columns == batch.columns
    got = run(spark, table, lambda s: st.rate_limit_stream(s, 1, delay="30 seconds"), tmp_path / "r")
    assert ids(got) == ids(stateful.rate_limit_logs(batch, 1))
    assert 0 < got.count() < batch.count()


def test_alerts(spark, table, tmp_path):
    batch = table[0]
    rule = AlertRule("ERROR", threshold=3, window=6, name="r")
    got = run(spark, table, lambda s: st.alert_stream(s, rule, "30 seconds"), tmp_path / "w")
    assert ids(got) == ids(stateful.alert_logs(batch, [rule]))
    rule = AlertRule("ERROR", threshold=3, window=0, name="r")
    got = run(spark, table, lambda s: st.alert_stream(s, rule, "30 seconds"), tmp_path / "u")
    per_source = batch.where("level = 'error'").groupBy("source").count().collect()
    assert got.count() == sum(r["count"] // 3 for r in per_source)


def test_tumbling_counts(spark, table, tmp_path):
    got = run(spark, table, lambda s: st.tumbling_counts_stream(s, 20, "30 seconds", null_ts="drop"), tmp_path)
    want = aggregate.tumbling_counts_long(table[0], 20, null_ts="drop")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tumbling_counts_keep_rows_without_a_time(spark, table, tmp_path):
    got = run(spark, table, lambda s: st.tumbling_counts_stream(s, 20, "30 seconds", null_ts="keep"), tmp_path)
    want = aggregate.tumbling_counts_long(table[0], 20)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.where("window_start IS NULL AND window_end IS NULL").agg(F.sum("total")).first()[0] == sum(r["ts"] is None for r in table[2])


def test_dedup(spark, table, tmp_path):
    got = run(spark, table, lambda s: st.dedup_stream(s, "1 hour"), tmp_path)
    timed = [r for r in table[2] if r["ts"]]
    assert {(r["source"], r["message"]) for r in got.collect()} == {(r["source"], r["message"]) for r in timed}


def in_time_order(rows):
    """What a closed stream's fold sees: rows without a time as their file comes, the others by time."""
    untimed = [r for r in rows if r["ts"] is None]
    return untimed + sorted((r for r in rows if r["ts"]), key=lambda r: (r["ts"], r["seq"]))


def test_anchored_windows(spark, table, tmp_path):
    got = run(spark, table, lambda s: st.anchored_windows_stream(s, 15, "30 seconds"), tmp_path)
    want, start = {}, {}
    for r in in_time_order(table[2]):
        key = r["source"]
        if r["ts"] is None:
            want[(key, r["seq"])] = (None, None)
            continue
        if key not in start or r["ts"] >= start[key] + timedelta(seconds=15):
            start[key] = r["ts"]
        want[(key, r["seq"])] = (start[key], start[key] + timedelta(seconds=15))
    utc = lambda t: t and t.replace(tzinfo=timezone.utc)
    assert {(r["source"], r["seq"]): (utc(r["window_start"]), utc(r["window_end"])) for r in got.collect()} == want


def test_dedup_by_count_and_its_report(spark, table, tmp_path):
    # Rows without a time are decided as they arrive, before or after others; compare on the rest.
    timed = (table[0].where("ts IS NOT NULL"), table[1], [r for r in table[2] if r["ts"]])
    passed, held = {}, {}
    seen = {}
    for r in in_time_order(timed[2]):
        memory = seen.setdefault(r["source"], {})
        n = memory[r["message"]] = memory.get(r["message"], 0) + 1
        if n <= 2:
            passed[(r["source"], r["seq"])] = n
            if len(memory) > 2:
                del memory[next(iter(memory))]
        else:
            held[(r["source"], r["seq"])] = n
    for report, want in ((False, passed), (True, held)):
        got = run(spark, timed, lambda s: st.dedup_count_stream(s.where("ts IS NOT NULL"), 2, 2, report, "30 seconds"), tmp_path / str(report))
        assert {(r["source"], r["seq"]): r["occurrence"] for r in got.collect()} == want and want


def test_numbers_and_nth(spark, table, tmp_path):
    for every in (1, 4):
        got = run(spark, table, lambda s: st.numbered_stream(s, every=every, delay="30 seconds"), tmp_path / str(every)).collect()
        for source in "ab":
            mine = sorted((r for r in got if r["source"] == source), key=lambda r: r["position"])
            n = sum(r["source"] == source for r in table[2])
            assert [r["position"] for r in mine] == list(range(every, n + 1, every))
            times = [r["ts"] for r in mine if r["ts"]]
            assert times == sorted(times)


def test_sinks_get_the_batch_number(spark, table, tmp_path):
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(table[1])
    numbers = []

    def sink(rows, number):
        numbers.append(number)
        rows.select("source", "seq").write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    st.tee_stream(stream, {"a": sink}, f"{tmp_path}/cp").awaitTermination()
    assert numbers == list(range(10)) and spark.read.parquet(f"{tmp_path}/out").count() == 300


def test_unclosed_streams_keep_waiting_rows(spark, table, tmp_path):
    got = run(spark, table, lambda s: st.rate_limit_stream(s, 1000, delay="30 seconds"), tmp_path, closed=False)
    assert got.count() < 300
