"""Each fold, cut into chunks every which way, against a plain sequential model."""

import random
from collections import OrderedDict, deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logloom.operators import stateful as S
from logloom.operators.rules import AlertRule

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def make_rows(rng, n, sources, step, messages=5, jitter=0.0):
    """Rows of several sources; the first one holds most of them."""
    rows, clock = [], {s: 0.0 for s in sources}
    for i in range(n):
        source = sources[0] if rng.random() < 0.6 else rng.choice(sources)
        clock[source] += rng.choice([0, step, step, 10 * step])
        at = clock[source] + (rng.uniform(-jitter, jitter) if jitter else 0)
        ts = BASE + timedelta(seconds=round(at, 3))
        rows.append(
            dict(
                source=source,
                seq=i,
                ts=ts,
                timestamp=ts.strftime("%Y-%m-%dT%H:%M:%S.%fZ"),
                level=rng.choice(["error", "info"]),
                message=f"m{rng.randrange(messages)}",
            )
        )
    return rows


def by_source(rows, order):
    groups = {}
    for row in sorted(rows, key=order):
        groups.setdefault(row["source"], []).append(row)
    return groups


def in_time(row):
    return (row["ts"], row["seq"])


def in_arrival(row):
    return row["seq"]


def ids(df):
    return sorted((r["source"], r["seq"]) for r in df.select("source", "seq").collect())


def throttle_model(rows, width, limit, key):
    kept, state = [], {}
    for row in sorted(rows, key=in_time):
        passed = state.setdefault((row["source"], key(row)), [])
        live = [t for t in passed if t >= row["ts"] - timedelta(seconds=width)]
        if len(live) < limit:
            live.append(row["ts"])
            kept.append((row["source"], row["seq"]))
        state[(row["source"], key(row))] = live
    return sorted(kept)


@pytest.mark.parametrize("partitions,limit,step", [(1, 1, 1.0), (7, 1, 0.3), (11, 3, 0.3), (16, 2, 5.0)])
def test_throttle_matches_model(logs, partitions, limit, step):
    rows = make_rows(random.Random(partitions), 600, ["a", "b", "c"], step)
    got = S.throttle_logs(logs(rows), 10, limit, partitions=partitions)
    assert ids(got) == throttle_model(rows, 10, limit, lambda r: r["message"])


def jobs_of(spark, run):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("count-jobs", "count jobs")
    before = len(tracker.getJobIdsForGroup("count-jobs"))
    run()
    after = len(tracker.getJobIdsForGroup("count-jobs"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return after - before


def test_jobs_do_not_grow_with_chunks(spark, logs):
    """Step functions and merging buffers settle a key of any number of chunks alike."""
    rows = make_rows(random.Random(5), 400, ["a"], 0.05, jitter=2.0)
    df = logs([dict(r, timestamp=r["ts"].isoformat()) for r in rows])
    for operator in (
        lambda n: S.throttle_logs(df, 3, 1, key=F.lit("k"), partitions=n),
        lambda n: S.anchored_windows(df, 3, partitions=n),
        lambda n: S.sequence_logs(df, 20, partitions=n),
    ):
        few, many = (jobs_of(spark, lambda n=n: operator(n).count()) for n in (5, 25))
        assert abs(many - few) <= 2


def test_throttle_of_one_saturated_key_needs_many_rounds(logs):
    rows = make_rows(random.Random(5), 400, ["a"], 0.05)
    got = S.throttle_logs(logs(rows), 3, 1, key=F.lit("k"), partitions=14)
    assert ids(got) == throttle_model(rows, 3, 1, lambda r: "k")
    got = S.throttle_logs(logs(rows), 3, 4, key=F.lit("k"), partitions=9)
    assert ids(got) == throttle_model(rows, 3, 4, lambda r: "k")


@pytest.mark.parametrize("rate", [1.0, 2.5, 3])
def test_rate_limit_matches_model(logs, rate):
    import math

    rows = make_rows(random.Random(3), 500, ["a", "b"], 0.2)
    got = S.rate_limit_logs(logs(rows), rate, partitions=9)
    assert ids(got) == throttle_model(rows, 1, math.ceil(rate), lambda r: "")


def alert_model(rows, rule):
    fired = []
    for source, group in by_source(rows, in_time).items():
        hits = []
        for row in group:
            if row["level"] != rule.level or (rule.keyword and rule.keyword not in row["message"]):
                continue
            if rule.window:
                hits = [t for t in hits if t >= row["ts"] - timedelta(seconds=rule.window)]
            hits.append(row["ts"])
            if len(hits) >= rule.threshold:
                fired.append((source, row["seq"]))
                hits = []
    return sorted(fired)


@pytest.mark.parametrize("threshold,window", [(1, 60), (3, 5), (2, 1), (4, 30)])
def test_alerts_match_model(logs, threshold, window):
    rows = make_rows(random.Random(threshold), 500, ["a", "b", "c"], 0.5)
    rule = AlertRule("error", None, threshold, window, "r")
    assert ids(S.alert_logs(logs(rows), [rule], partitions=10)) == alert_model(rows, rule)


def test_unbounded_alert_counts_in_arrival_order(logs):
    rows = make_rows(random.Random(1), 300, ["a", "b"], 1.0)
    rule = AlertRule("ERROR", "m1", 3, 0, "r")
    expected = []
    for source, group in by_source(rows, in_arrival).items():
        hits = [r["seq"] for r in group if r["level"] == "error" and "m1" in r["message"]]
        expected += [(source, s) for s in hits[2::3]]
    assert ids(S.alert_logs(logs(rows), [rule])) == sorted(expected)


@pytest.mark.parametrize("jitter", [0.0, 8.0])
def test_anchored_windows_match_model(logs, jitter):
    rows = make_rows(random.Random(8), 500, ["a", "b", "c"], 0.7, jitter=jitter)
    expected = {}
    for source, group in by_source(rows, in_arrival).items():
        start = None
        for row in group:
            if start is None or row["ts"] >= start + timedelta(seconds=10):
                start = row["ts"]
            expected[(source, row["seq"])] = int(start.timestamp() * 1e6 + 0.5)
    got = S.anchored_windows(logs(rows), 10, partitions=9)
    got = got.select("source", "seq", F.unix_micros("window_start").alias("w")).collect()
    assert {(r["source"], r["seq"]): r["w"] for r in got} == expected


def dedup_model(rows, size, repeats):
    kept, suppressed = [], []
    for source, group in by_source(rows, in_arrival).items():
        seen = OrderedDict()
        for row in group:
            key = row["message"].strip()
            n = seen.get(key, 0)
            seen[key] = n + 1
            if n < repeats:
                kept.append((source, row["seq"]))
                while len(seen) > size:
                    seen.popitem(last=False)
            else:
                suppressed.append((source, row["seq"], n + 1))
    return sorted(kept), sorted(suppressed)


@pytest.mark.parametrize("size,repeats,messages", [(256, 1, 30), (10, 1, 30), (10, 2, 14), (3, 3, 40)])
def test_bounded_dedup_matches_model(logs, size, repeats, messages):
    rows = make_rows(random.Random(size), 600, ["a", "b", "c"], 1.0, messages=messages)
    kept, suppressed = dedup_model(rows, size, repeats)
    assert ids(S.dedup_logs(logs(rows), size, repeats, partitions=8)) == kept
    got = S.suppressed_logs(logs(rows), size, repeats, partitions=8).select("source", "seq", "occurrence")
    assert sorted(map(tuple, got.collect())) == suppressed


@pytest.mark.parametrize("size,jitter", [(1, 3.0), (5, 3.0), (50, 200.0), (500, 5.0)])
def test_sequence_matches_model(logs, size, jitter):
    rows = make_rows(random.Random(size), 400, ["a", "b"], 1.0, jitter=jitter)
    rows[7]["timestamp"] = rows[7]["ts"] = None
    expected = {}
    for source, group in by_source(rows, in_arrival).items():
        buffer, out = [], []
        for row in group:
            buffer.append(row)
            buffer.sort(key=lambda r: r["timestamp"] or "")
            if len(buffer) > size:
                out.append(buffer.pop(0))
        expected.update({(source, r["seq"]): i for i, r in enumerate(out + buffer, 1)})
    got = S.sequence_logs(logs(rows), size, partitions=7).select("source", "seq", "position").collect()
    assert {(r[0], r[1]): r[2] for r in got} == expected
