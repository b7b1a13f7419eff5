"""What the sequential streams hold while rows wait."""

from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from logloom.plans import stream_queries as q
from logloom.schema import LOG_SCHEMA
from logloom.streaming import operators as st

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Four sources of two users each, an event a minute; some rows lack a time."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = [(i, START + timedelta(minutes=i) if i % 17 else None, i % 4 + 8 * (i % 3 % 2), "click", float(i), f'{{"k": {i % 5}}}') for i in range(400)]
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    table = pa.table(dict(zip(names, map(list, zip(*rows)))))
    pq.write_table(table.set_column(1, "ts", table["ts"].cast(pa.timestamp("us"))), f"{path}/events.parquet")
    return path


class State:
    """As much of a group's state as the fold uses."""

    def __init__(self):
        self.value, self.mark, self.wake = None, 0, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.mark

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        self.wake = at


def test_waiting_rows_are_compact_and_leave_in_slices():
    def number(count, times, _):
        numbers = np.arange(1, len(times) + 1) + (count or 0)
        return int(numbers[-1]), np.arange(len(times)), {"position": numbers}

    schema = pa.schema([("seq", pa.int64()), ("t", pa.int64())])
    run = st._in_time_order(number, lambda _: st._FOREVER, schema, ["seq", "t"])
    rng, state, n = np.random.default_rng(5), State(), 100_000
    seqs = rng.permutation(n)
    frames = (pd.DataFrame({"seq": part, "t": part // 3 * 1000 + 1000}) for part in np.array_split(seqs, 10))
    assert not [*run(("a", 0), frames, state)]
    assert sum(len(v) for v in state.value) < 17 * n
    state.mark = n
    out = [*run(("a", 0), iter([]), state)]
    assert max(map(len, out)) <= 2 * st._SLICE and len(out) > 1
    got = pd.concat(out)
    assert got["seq"].tolist() == list(range(n)) and got["position"].tolist() == list(range(1, n + 1))
    assert state.value[1] is None and state.wake > 0


#: What each operator is given.
TAKEN = {
    "stream_sequence": ("numbered_stream", ["source", "seq", "ts"]),
    "stream_nth": ("numbered_stream", ["source", "seq", "ts"]),
    "stream_rate_limit": ("rate_limit_stream", ["source", "seq", "ts"]),
    "stream_dedup_count": ("dedup_count_stream", ["source", "seq", "ts", "message"]),
    "stream_suppressed": ("dedup_count_stream", ["source", "seq", "ts", "message"]),
    "stream_anchored": ("anchored_windows_stream", ["source", "seq", "ts"]),
}


def check_taken(monkeypatch, spark, events, name):
    operator, columns = TAKEN[name]
    seen, plain = [], getattr(st, operator)

    def watched(df, *args, **kwargs):
        seen.append(df.columns)
        return plain(df, *args, **kwargs)

    monkeypatch.setattr(st, operator, watched)
    assert getattr(q, name)(spark, events).count()
    assert seen == [columns]


def test_sequence_takes_what_it_needs(monkeypatch, spark, events):
    check_taken(monkeypatch, spark, events, "stream_sequence")


def test_nth_takes_what_it_needs(monkeypatch, spark, events):
    check_taken(monkeypatch, spark, events, "stream_nth")


def test_rate_limit_takes_what_it_needs(monkeypatch, spark, events):
    check_taken(monkeypatch, spark, events, "stream_rate_limit")


def test_dedup_count_takes_what_it_needs(monkeypatch, spark, events):
    check_taken(monkeypatch, spark, events, "stream_dedup_count")


def test_suppressed_takes_what_it_needs(monkeypatch, spark, events):
    check_taken(monkeypatch, spark, events, "stream_suppressed")


def test_anchored_takes_what_it_needs(monkeypatch, spark, events):
    check_taken(monkeypatch, spark, events, "stream_anchored")


def test_throttle_groups_do_not_grow_with_the_keys(spark, logs, tmp_path):
    rows = [dict(source="a", seq=i, ts=START + timedelta(seconds=i % 60), service=f"s{i % 400}") for i in range(800)]
    logs(rows).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(LOG_SCHEMA).parquet(f"{tmp_path}/in")
    out = st.throttle_stream(stream, 3600, 1, stream["service"])
    query = out.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert 0 < max(held) <= st._BUCKETS


@pytest.mark.parametrize("keyed", [False, True])
def test_runs_are_merged_in_order(monkeypatch, keyed):
    """Equal times, blocks of equal times, missing numbers and rows that arrive in parts, over runs of some blocks each."""
    monkeypatch.setattr(st, "_SLICE", 7)
    monkeypatch.setattr(st, "_RUN_ROWS", 20)

    def number(count, times, _):
        numbers = np.arange(1, len(times) + 1) + (count or 0)
        return int(numbers[-1]), np.arange(len(times)), {"position": numbers}

    schema = pa.schema([("seq", pa.int64()), ("t", pa.int64()), *([("_key", pa.binary(16))] if keyed else [])])
    run = st._in_time_order(number, lambda _: st._FOREVER, schema, ["seq", "t"])
    rng = np.random.default_rng(6)
    keys = [bytes([k]) * 16 for k in range(3)]
    rows = [(seq if seq % 50 else None, int(t) * 1000, keys[seq % 3]) for seq, t in zip(rng.permutation(400), rng.integers(1, 9, 400))]
    state, got = State(), []
    for low in range(0, 400, 100):
        frame = pd.DataFrame(rows[low : low + 100], columns=["seq", "t", "_key"]).astype({"seq": "Int64"})
        parts = [frame.iloc[i : i + 9] for i in range(0, 100, 9)]
        got += [*run(("a", 0), iter(parts), state)]
    assert not got
    for state.mark in (4, 8):
        got += [*run(("a", 0), iter([]), state)]
        assert sum(map(len, got)) == sum(t <= state.mark * 1000 for _, t, _ in rows)
    found = {}
    for seq, t, position in pd.concat(got)[["seq", "t", "position"]].itertuples(index=False):
        key = 0 if not keyed else None if pd.isna(seq) else int(seq) % 3
        found.setdefault(key, []).append((position, t, None if pd.isna(seq) else int(seq)))
    for key, placed in found.items():
        if key is not None:
            placed = sorted(placed)
            assert [p[1:] for p in placed] == sorted((p[1:] for p in placed), key=lambda p: (p[0], p[1] is None, p[1] or 0))
            assert keyed or [p[0] for p in placed] == list(range(1, 401))


#: Each operator that holds rows, as its query calls it.
HELD = {
    "stream_nth": lambda df: st.numbered_stream(df, every=7),
    "stream_rate_limit": lambda df: st.rate_limit_stream(df, 2),
    "stream_dedup_count": lambda df: st.dedup_count_stream(df, 40),
    "stream_suppressed": lambda df: st.dedup_count_stream(df, 40, report=True),
    "stream_anchored": lambda df: st.anchored_windows_stream(df, 20_000),
}


def check_held(monkeypatch, logs, name):
    """Of a million rows that wait, less than half is unpacked at any time, when they arrive and when they are decided."""

    class Caught(Exception):
        pass

    caught = []

    def keyed(df, step, reach, *_, **given):
        caught.extend((step, reach, "digest" in given))
        raise Caught

    monkeypatch.setattr(st, "_keyed", keyed)
    with pytest.raises(Caught):
        HELD[name](logs([dict(source="a", seq=1, ts=START, message="m")]))
    plain, reach, digested = caught
    n, most, base = 1_000_000, [0], pa.total_allocated_bytes()

    def note():
        most[0] = max(most[0], pa.total_allocated_bytes() - base)

    def step(kept, times, digests):
        note()
        return plain(kept, times, digests)

    def frames():
        rng = np.random.default_rng(7)
        texts = np.array([bytes([i]) * 16 for i in range(30)], object)
        for part in np.array_split(rng.permutation(n), 100):
            note()
            frame = pd.DataFrame({"seq": part, "t": part * 1000 + 1000})
            yield frame.assign(_digest=texts[part % 30]) if digested else frame

    schema = pa.schema([("seq", pa.int64()), ("t", pa.int64()), *([("_digest", pa.binary(16))] if digested else [])])
    run, state = st._in_time_order(step, reach, schema, ["seq", "t"]), State()
    assert not [*run(("a", 0), frames(), state)]
    state.mark = n + 1
    assert sum(map(len, run(("a", 0), iter([]), state)))
    assert 0 < most[0] < n * (32 if digested else 16) / 2


def test_suppressed_unpacks_some_blocks(monkeypatch, logs):
    check_held(monkeypatch, logs, "stream_suppressed")


def test_anchored_unpacks_some_blocks(monkeypatch, logs):
    check_held(monkeypatch, logs, "stream_anchored")


def test_dedup_count_unpacks_some_blocks(monkeypatch, logs):
    check_held(monkeypatch, logs, "stream_dedup_count")


def test_rate_limit_unpacks_some_blocks(monkeypatch, logs):
    check_held(monkeypatch, logs, "stream_rate_limit")


def test_nth_unpacks_some_blocks(monkeypatch, logs):
    check_held(monkeypatch, logs, "stream_nth")


def test_blocks_stay_whole_over_many_arrivals(monkeypatch):
    monkeypatch.setattr(st, "_SLICE", 50)
    schema = pa.schema([("seq", pa.int64()), ("t", pa.int64())])
    run = st._in_time_order(lambda kept, times, _: (kept, np.arange(len(times)), {}), lambda _: 0, schema, ["seq", "t"])
    rng, state = np.random.default_rng(8), State()
    for i in range(60):
        seqs = np.arange(10) + 10 * i
        assert not [*run(("a", 0), iter([pd.DataFrame({"seq": seqs, "t": rng.integers(1, 1000, 10) * 1000})]), state)]
    blocks = [*pa.ipc.open_stream(state.value[1])]
    assert [len(b) for b in blocks] == [50] * 12
    times = np.concatenate([b["t"].to_numpy() for b in blocks])
    assert (np.diff(times) >= 0).all()


class Handle:
    """As much of a processor's handle as a source without a key uses: values, a map and timers."""

    def __init__(self):
        self.value, self.entries, self.timers = None, {}, set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        entries = self.entries
        return SimpleNamespace(getValue=entries.__getitem__, updateValue=entries.__setitem__, removeKey=entries.pop)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def at(watermark):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)


def test_dedup_count_holds_distinct_messages_in_entries(monkeypatch):
    """Rows with messages of their own arrive in parts, wait in bounded entries, and leave in order, some blocks unpacked at a time."""
    for name, value in {"_SLICE": 1000, "_RUN_ROWS": 4000, "_MOST_RUNS": 5}.items():
        monkeypatch.setattr(st, name, value)
    n, most, base = 100_000, [0], pa.total_allocated_bytes()

    def step(count, times, digests):
        most[0] = max(most[0], pa.total_allocated_bytes() - base)
        assert len(set(digests)) == len(times)
        numbers = np.arange(1, len(times) + 1) + (count or 0)
        return int(numbers[-1]), np.arange(len(times)), {"position": numbers}

    schema = pa.schema([("seq", pa.int64()), ("t", pa.int64()), ("_digest", pa.binary(16))])
    waiting = st._Waiting(st._deciding(step, ["seq", "t"]), lambda _: st._FOREVER, schema, schema.names)
    handle, rng = Handle(), np.random.default_rng(9)
    waiting.init(handle)
    texts = np.array([bytes(row) for row in rng.integers(0, 256, (n, 16), np.uint8)], object)

    def frames(seqs):
        for part in np.array_split(seqs, 50):
            most[0] = max(most[0], pa.total_allocated_bytes() - base)
            # Names are lost on the way to a processor.
            yield pd.DataFrame({"a": part, "b": part // 3 * 1000 + 1000, "c": texts[part]})

    for seqs in np.array_split(rng.permutation(n), 2):
        assert not [*waiting.handleInputRows(("a",), frames(seqs), at(0))]
    sizes = [len(rows) for (rows,) in handle.entries.values()]
    assert sum(sizes) > 16 * n and max(sizes) < 48 * st._SLICE
    assert handle.timers == {2}
    out = []
    for mark in (n // 6, n):
        for timer in [t for t in handle.timers if t <= mark]:
            out += waiting.handleExpiredTimer(("a",), at(mark), None)
            handle.timers.remove(timer)
    got = pd.concat(out)
    assert got["seq"].tolist() == list(range(n)) and got["position"].tolist() == list(range(1, n + 1))
    assert not handle.entries and not handle.timers and handle.value is not None
    assert 0 < most[0] < n * 32 / 4


def test_dedup_count_has_more_than_one_state_a_source(spark, logs, tmp_path):
    for part in range(3):
        rows = [dict(source="ab"[i % 2], seq=i, ts=START + timedelta(seconds=i), message=f"m{i // 4}") for i in range(part * 40, part * 40 + 40)]
        logs(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    end, progress = f"{tmp_path}/end", []
    out = st.dedup_count_stream(st.closable(stream, end), 40)

    def start():
        query = out.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        progress.extend(query.recentProgress)
        return query

    st.run_closed(out, start, end, LOG_SCHEMA)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) > 2
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out")
    assert sorted(row["seq"] for row in got.collect()) == [i for i in range(120) if i % 4 < 2]
