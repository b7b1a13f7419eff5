"""Streaming forms of the operators.

Row-wise operators (filters, rewriting, tagging) and the parser take streaming frames as they are. The ones
here keep state. All use event time and need a ``delay``: rows later than the watermark are dropped. Rows without a time
cannot wait for a watermark: they are decided as they arrive.

The sequential operators depend on order, so rows wait in state until the watermark has passed them, are then
taken in time order, and run through the same fold as the batch operator. Their results agree with the batch
operator on all rows the watermark has passed. A bounded run passes the last rows, too, by :func:`closable` and
:func:`close`. A key's state goes once nothing waits and nothing it remembers is in reach.
"""

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, MapType, StructField, StructType, TimestampType

from logloom.functions.text import or_default
from logloom.operators.aggregate import MICROS, UNKNOWN, level_name
from logloom.operators.folds import AlertFold, AnchorFold, DedupFold, PickFold, ThrottleFold
from logloom.operators.rules import AlertRule, Route, require
from logloom.operators.stateful import alert_hits, message_digest, micros
from logloom.sinks.files import dispatch_routes, tee_logs
from logloom.workers import ship_package

#: The source of the row that ends a stream.
END = "\0end"
_END_TIME = "2200-01-01 00:00:00"  # pandas counts nanoseconds up to 2262
#: Stands for no time where counts wait for the end of the stream; before the end by more than any delay.
_NO_TIME = "2150-01-01 00:00:00"
#: In folds: no memory is ever out of reach.
_FOREVER = 1 << 62
#: Rows that are decided, written to a state or handed on at a time.
_SLICE = 20_000
#: A run of arriving rows ends with the batch in which it reaches either.
_RUN_ROWS, _RUN_BYTES = 16 * _SLICE, 64 << 20
#: Of a source without a key: bytes of a block of waiting rows before compression, and runs that wait unmerged.
_BLOCK_BYTES, _MOST_RUNS = 4 << 20, 32
#: Groups into which the keys of a source are dealt.
_BUCKETS = 64

#: From what is kept, and the times and digests of the next rows in time order: what to keep, which rows to pick, and further columns of those.
Step = Callable[[object, np.ndarray, list | None], tuple[object, np.ndarray, dict[str, np.ndarray]]]
Reach = Callable[[object], int]


def closable(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a stream that :func:`close` can end; ``path`` is an empty folder of its own in shared storage."""
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.mode("ignore").parquet(path)
    return df.unionByName(spark.readStream.schema(df.schema).parquet(path))


def close(spark: SparkSession, path: str, schema: StructType) -> None:
    """Write the row that moves the watermark past all others. Then run the query once more, from its checkpoint."""
    end = {"source": F.lit(END), "ts": F.lit(_END_TIME).cast("timestamp"), "seq": F.lit(0)}
    row = spark.range(1).select(*(end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    row.write.mode("append").parquet(path)


def run_closed(stream: DataFrame, start: Callable, path: str, schema: StructType) -> None:
    """Run a closable stream over all available input, end it, and run it to its end. ``start`` starts the query."""
    start().awaitTermination()
    close(stream.sparkSession, path, schema)
    start().awaitTermination()


def tumbling_counts_stream(
    df: DataFrame, window_seconds: int = 60, delay: str = "1 minute", null_ts: str = "keep"
) -> DataFrame:
    """Counts per source, epoch-aligned window, level and service; final once the watermark passes a window.

    Rows without a time are counted under a NULL window by default, as the batch operator does; more of them may come
    at any time, so those counts are final, and given, when the stream is closed. ``null_ts="drop"`` leaves them out.
    """
    require(window_seconds > 0, "window_seconds must be positive")
    require(null_ts in ("keep", "drop"), "null_ts must be 'keep' or 'drop'")
    marked = df.withWatermark("ts", delay)
    untimed, time = F.lit(False), F.col("ts")
    if null_ts == "keep":
        # A column of its own, so that the watermark follows real times only; it carries the watermark's mark.
        filled = F.coalesce("ts", F.lit(_NO_TIME).cast(df.schema["ts"].dataType))
        untimed, time = F.col("ts").isNull(), F.col("_time")
        marked = marked.withColumn("_time", filled.alias("_time", metadata=marked.schema["ts"].metadata))
    counted = marked.groupBy(
        "source",
        F.window(time, f"{window_seconds} seconds").alias("window"),
        untimed.alias("untimed"),
        level_name().alias("level"),
        or_default(F.col("service"), UNKNOWN).alias("service"),
    ).agg(F.count("*").alias("total"))
    bounds = (F.when(~F.col("untimed"), F.col(f"window.{side}")).alias(f"window_{side}") for side in ("start", "end"))
    return counted.select("source", *bounds, "level", "service", "total")


def dedup_stream(df: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The first row of each message per source, remembered for ``delay`` (bounded by time, not by count)."""
    keyed = df.withColumn("_digest", message_digest()).withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["source", "_digest"]).where(F.col("source") != END).drop("_digest")


class _Run:
    """Rows in the order of time and ``seq``, written as compressed blocks that are read one at a time."""

    def __init__(self, schema: pa.Schema):
        self._sink, self._some = pa.BufferOutputStream(), schema.empty_table()
        self._writer = pa.ipc.new_stream(self._sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))

    def add(self, rows: pa.Table) -> None:
        """Only whole blocks are written, however few rows come at a time."""
        self._some = pa.concat_tables([self._some, rows])
        if whole := len(self._some) // _SLICE * _SLICE:
            self._write(self._some.slice(0, whole))
            self._some = self._some.slice(whole)

    def _write(self, rows: pa.Table) -> None:
        self._writer.write_table(rows.combine_chunks(), max_chunksize=_SLICE)

    def packed(self) -> bytes:
        if len(self._some):
            self._write(self._some)
        self._writer.close()
        return self._sink.getvalue().to_pybytes()


def _arrow(batch: pd.DataFrame, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(batch[field.name], field.type, from_pandas=True) for field in schema], schema)


def _places(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Times and numbers; rows without a number come last."""
    return rows["t"].to_numpy(), rows["seq"].fill_null(np.iinfo(np.int64).max).to_numpy()


def _sorted(parts: list[pa.Table]) -> pa.Table:
    rows = pa.concat_tables(parts).combine_chunks()
    times, seqs = _places(rows)
    return rows.take(np.lexsort((seqs, times)))


def _sorted_parts(parts: Iterable[pa.Table]) -> Iterator[pa.Table]:
    """Rows in any order as sorted tables of bounded size."""
    some: list[pa.Table] = []
    for rows in parts:
        some.append(rows)
        if sum(map(len, some)) >= _RUN_ROWS or sum(part.nbytes for part in some) >= _RUN_BYTES:
            yield _sorted(some)
            some.clear()
    if some:
        yield _sorted(some)


def _packed(rows: pa.Table) -> bytes:
    run = _Run(rows.schema)
    run.add(rows)
    return run.packed()


def _unpacked(run: bytes) -> Iterator[pa.Table]:
    return (pa.Table.from_batches([block]) for block in pa.ipc.open_stream(pa.py_buffer(run)))


def _merged(runs: Iterable[Iterator[pa.Table]]) -> Iterator[pa.Table]:
    """The rows of all runs in order, some at a time; in memory is a block of each run."""
    waiting = [[run, None] for run in runs]
    while True:
        for entry in waiting:
            if entry[1] is None:
                entry[1] = next(entry[0], None)
        waiting = [entry for entry in waiting if entry[1] is not None]
        if not waiting:
            return
        places = [_places(block) for _, block in waiting]
        # Nothing that is still to be read comes before the first of the blocks' ends.
        time, seq = min((times[-1], seqs[-1]) for times, seqs in places)
        taken = []
        for entry, (times, seqs) in zip(waiting, places):
            low, high = np.searchsorted(times, time, "left"), np.searchsorted(times, time, "right")
            count = low + np.searchsorted(seqs[low:high], seq, "right")
            if count:
                taken.append(entry[1].slice(0, count))
                entry[1] = entry[1].slice(count) if count < len(times) else None
        yield _sorted(taken) if len(taken) > 1 else taken[0]


def _key_order(rows: pa.Table) -> tuple[np.ndarray, list, np.ndarray]:
    """The order by key of rows in time order; the keys; and where in it each key begins and the last one ends."""
    if "_key" not in rows.column_names:
        return np.arange(len(rows)), [b""], np.array([0, len(rows)])
    encoded = rows["_key"].combine_chunks().dictionary_encode()
    keys, codes = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    return order, keys, np.searchsorted(codes[order], np.arange(len(keys) + 1))


def _deciding(step: Step, shown: Sequence[str]) -> Callable:
    """From a source, what ``step`` keeps for each key, and the next rows in time order: the rows it picks, as frames.

    Only some thousand rows at a time become Python objects.
    """

    def decide(source, kept: dict, rows: pa.Table) -> Iterator[pd.DataFrame]:
        order, keys, bounds = _key_order(rows)
        times = rows["t"].to_numpy()
        shown_rows, at, extra, waiting = rows.select(shown), [], [], 0

        def take() -> pd.DataFrame:
            out = shown_rows.take(np.concatenate(at)).to_pandas(integer_object_nulls=True)
            names = extra[0]
            out = out.assign(source=source, **{name: np.concatenate([e[name] for e in extra]) for name in names})
            at.clear()
            extra.clear()
            return out

        for number, key in enumerate(keys):
            for low in range(bounds[number], bounds[number + 1], _SLICE):
                part = order[low : min(low + _SLICE, bounds[number + 1])]
                digests = rows["_digest"].take(part).to_pylist() if "_digest" in rows.column_names else None
                kept[key], picked, added = step(kept.get(key), times[part], digests)
                at.append(part[picked])
                extra.append(added)
                waiting += len(at[-1])
                if waiting >= _SLICE:
                    yield take()
                    waiting = 0
        if waiting:
            yield take()

    return decide


def _in_time_order(step: Step, reach: Reach, schema: pa.Schema, shown: Sequence[str]) -> Callable:
    """State: what ``step`` keeps for each key, and the rows the watermark has not passed, as one sorted run.

    Rows that arrive are sorted in runs of bounded size and merged with those; only blocks of the runs are unpacked. The
    state goes to Python and back whole, so this is for the many small groups of a source with keys.
    """
    decide = _deciding(step, shown)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, held = state.get if state.exists else (None, None)
        kept = {} if kept is None else pickle.loads(kept)
        mark = state.getCurrentWatermarkMs() * 1000
        runs = [] if held is None else [held]
        runs.extend(map(_packed, _sorted_parts(_arrow(b, schema) for b in batches if len(b))))
        readers = [_unpacked(run) for run in runs]
        runs.clear()
        waiting, oldest = _Run(schema), None
        for rows in _merged(readers):
            times = rows["t"].to_numpy()
            ready = int(np.searchsorted(times, mark, "right"))
            if ready:
                yield from decide(key[0], kept, rows.slice(0, ready))
            if ready < len(times):
                oldest = int(times[ready]) if oldest is None else oldest
                waiting.add(rows.slice(ready))
        # What is out of the reach of all rows to come decides nothing any more.
        kept = {k: v for k, v in kept.items() if reach(v) >= mark}
        if oldest is None and not kept:
            if state.exists:
                state.remove()
            return
        state.update((pickle.dumps(kept), waiting.packed() if oldest is not None else None))
        wake = oldest if oldest is not None else max(map(reach, kept.values()))
        if wake < _FOREVER // 2:
            # When the watermark passes the oldest waiting row, or all that is remembered.
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return run


@dataclass
class _Held:
    """A sorted run in a map state: its number, the blocks of it that are left, the rows of the first that are done, and the oldest left."""

    number: int
    first: int
    end: int
    done: int
    oldest: int


class _Waiting(StatefulProcessor):
    """State of a source without a key: what the step keeps, and the rows the watermark has not passed, as sorted runs.

    The runs lie in a map state, a compressed block of rows an entry, and are read and written a block at a time. So Python
    holds a block of each run, however many rows wait, and blocks that the watermark has not reached are not read.
    """

    def __init__(self, decide: Callable, reach: Reach, schema: pa.Schema, names: Sequence[str]):
        self._decide, self._reach, self._schema, self._names = decide, reach, schema, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._about = handle.getValueState("about", "about binary")
        self._blocks = handle.getMapState("blocks", "run long, block long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept, runs, numbers, timer = self._load()
        # Names that begin with an underscore are lost on the way here.
        arrived = (_arrow(batch.set_axis(self._names, axis=1), self._schema) for batch in rows if len(batch))
        for part in _sorted_parts(arrived):
            runs.append(self._written(numbers, iter([part])))
            numbers += 1
            if len(runs) >= _MOST_RUNS:
                runs = [self._written(numbers, _merged([self._taken(run, _FOREVER) for run in runs]))]
                numbers += 1
        yield from self._advance(key[0], kept, runs, numbers, timer, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, runs, numbers, _ = self._load()
        # Spark deletes the timer that has expired.
        yield from self._advance(key[0], kept, runs, numbers, None, timerValues)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[dict, list[_Held], int, int | None]:
        return pickle.loads(self._about.get()[0]) if self._about.exists() else ({}, [], 0, None)

    def _written(self, number: int, parts: Iterator[pa.Table]) -> _Held:
        """The rows, already in order, as the run ``number``, in whole blocks however few come at a time."""
        run, some = None, self._schema.empty_table()
        for rows in parts:
            run = run or _Held(number, 0, 0, 0, int(rows["t"][0].as_py()))
            some = pa.concat_tables([some, rows])
            size = max(1, min(_SLICE, _BLOCK_BYTES * len(some) // max(some.nbytes, 1)))
            while len(some) >= size:
                self._write(run, some.slice(0, size))
                some = some.slice(size)
        if len(some):
            self._write(run, some)
        return run

    def _write(self, run: _Held, rows: pa.Table) -> None:
        self._blocks.updateValue((run.number, run.end), (_packed(rows),))
        run.end += 1

    def _taken(self, run: _Held, mark: int) -> Iterator[pa.Table]:
        """The rows of a run up to the time ``mark``, a block at a time; blocks without others are removed."""
        while run.first < run.end and run.oldest <= mark:
            block = (run.number, run.first)
            rows = pa.concat_tables(_unpacked(self._blocks.getValue(block)[0])).slice(run.done)
            times = rows["t"].to_numpy()
            ready = int(np.searchsorted(times, mark, "right"))
            if ready < len(times):
                run.done, run.oldest = run.done + ready, int(times[ready])
            else:
                self._blocks.removeKey(block)
                run.first, run.done = run.first + 1, 0
            if ready:
                yield rows.slice(0, ready)

    def _advance(self, source, kept: dict, runs: list[_Held], numbers: int, timer: int | None, timer_values) -> Iterator[pd.DataFrame]:
        """Decide the rows the watermark has passed, and set the timer for the next."""
        watermark = timer_values.getCurrentWatermarkInMs()
        mark = watermark * 1000
        for rows in _merged([self._taken(run, mark) for run in runs if run.oldest <= mark]):
            yield from self._decide(source, kept, rows)
        runs = [run for run in runs if run.first < run.end]
        # What is out of the reach of all rows to come decides nothing any more.
        kept = {k: v for k, v in kept.items() if self._reach(v) >= mark}
        wake = min((run.oldest for run in runs), default=max(map(self._reach, kept.values()), default=_FOREVER))
        # When the watermark passes the oldest waiting row, or all that is remembered.
        due = max(wake // 1000 + 1, watermark + 1) if wake < _FOREVER // 2 else None
        if due != timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            if due is not None:
                self._handle.registerTimer(due)
        if runs or kept:
            self._about.update((pickle.dumps((kept, runs, numbers, due)),))
        else:
            self._about.clear()


def _use_rocksdb(spark: SparkSession) -> None:
    """States of single entries need Spark's RocksDB store. Streams that began with another keep theirs, from their checkpoints."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "RocksDBStateStoreProvider"
    if not spark.conf.get(name).endswith(store):
        spark.conf.set(name, f"org.apache.spark.sql.execution.streaming.state.{store}")


def _keyed(
    df: DataFrame,
    step: Step,
    reach: Reach,
    delay: str,
    key: Column | None = None,
    digest: Column | None = None,
    added: Sequence[str] = (),
    untimed: int | None = None,
) -> DataFrame:
    """The rows ``step`` picks per source and ``key``, with the long columns ``added``; ``key`` and ``digest`` are 16 bytes.

    Rows without a time take part at the time ``untimed``, if given. The keys of a source are dealt into groups, each
    with one state; a source without keys has one of many entries.
    """
    ship_package(df.sparkSession)
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = df if untimed is not None else df.where(F.col("ts").isNotNull())
    # The source is the group's, and a time comes from its microseconds.
    rebuilt = {"source"} | ({"ts"} if df.schema["ts"].dataType == TimestampType() else set())
    shown = [field for field in df.schema if field.name not in rebuilt]
    maps = {field.name for field in shown if isinstance(field.dataType, MapType)}
    columns = {
        **{f.name: F.map_entries(f.name) if f.name in maps else F.col(f.name) for f in shown},
        "t": F.coalesce(time, F.lit(untimed)) if untimed is not None else time,
        **({"_key": key} if key is not None else {}),
        **({"_digest": digest} if digest is not None else {}),
    }
    bucket = [F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).alias("_bucket")] if key is not None else []
    marked = timed.withWatermark("ts", delay)
    times = ["ts"] if "ts" in rebuilt else []
    prepared = marked.select("source", *times, *bucket, *(c.alias(name) for name, c in columns.items()))
    held = StructType([f for f in prepared.schema if f.name in columns])
    fixed = {"_key": pa.binary(16), "_digest": pa.binary(16)}
    # Frames have local times without a zone.
    local = {f.name: pa.timestamp("ns") for f in held if f.dataType == TimestampType()}
    arrow = pa.schema([pa.field(f.name, (fixed | local).get(f.name) or f.type) for f in to_arrow_schema(held)])
    out = [f for f in prepared.schema if f.name in ("source", "t") or f.name in columns and f.name not in fixed]
    schema = StructType([*out, *(StructField(name, LongType()) for name in added)])
    names = [name for name in columns if name not in fixed]
    if key is None:
        _use_rocksdb(df.sparkSession)
        waiting = _Waiting(_deciding(step, names), reach, arrow, prepared.columns)
        found = prepared.groupBy("source").transformWithStateInPandas(waiting, schema, "append", "eventTime")
    else:
        run = _in_time_order(step, reach, arrow, names)
        found = prepared.groupBy("source", "_bucket").applyInPandasWithState(
            run, schema, "state binary, rows binary", "append", GroupStateTimeout.EventTimeTimeout
        )
    back = {name: F.map_from_entries(name) for name in maps}
    if times:
        at = F.timestamp_micros("t")
        back["ts"] = at if untimed is None else F.when(F.col("t") != untimed, at)
    return found.where(F.col("source") != END).select(*(back.get(c, F.col(c)).alias(c) for c in [*df.columns, *added]))


def _picking(fold: PickFold) -> Step:
    def step(kept, times, _):
        kept, picked = fold.pick(kept, times.tolist())
        return kept, np.asarray(picked, np.int64), {}

    return step


def _last_time(width: int, times) -> int:
    return max(times, default=-_FOREVER) + width


def _picked(df: DataFrame, fold: PickFold, delay: str, key: Column | None = None, untimed: int | None = None) -> DataFrame:
    return _keyed(df, _picking(fold), partial(_last_time, fold.width), delay, key, untimed=untimed)


def _with_untimed(df: DataFrame, passed: DataFrame) -> DataFrame:
    return passed.unionByName(df.where(F.col("ts").isNull()))


def throttle_stream(
    df: DataFrame,
    window_seconds: float,
    max_allowed: int = 1,
    key: Column | None = None,
    delay: str = "1 minute",
) -> DataFrame:
    """Per source and ``key`` (the message by default), at most ``max_allowed`` rows in any closed time window."""
    require(window_seconds > 0, "window_seconds must be positive")
    require(max_allowed >= 1, "max_allowed must be >= 1")
    text = F.coalesce(F.col("message") if key is None else key.cast("string"), F.lit(""))
    fold = ThrottleFold(micros(window_seconds), max_allowed)
    return _with_untimed(df, _picked(df, fold, delay, F.unhex(F.md5(F.encode(text, "UTF-8")))))


def rate_limit_stream(df: DataFrame, max_per_second: float, delay: str = "1 minute") -> DataFrame:
    """Per source, at most ``max_per_second`` rows in any closed second."""
    require(max_per_second > 0, "max_per_second must be positive")
    return _with_untimed(df, _picked(df, ThrottleFold(MICROS, -int(-max_per_second // 1)), delay))


def alert_stream(df: DataFrame, rule: AlertRule, delay: str = "1 minute") -> DataFrame:
    """The rows on which ``rule`` fires, per source.

    Without a time limit all hits count, those without a time as soon as they arrive.
    """
    hits = df.where(alert_hits(rule) | (F.col("source") == END))
    if rule.threshold == 1:
        hits = hits.where(F.col("source") != END)
    elif rule.window:
        hits = _picked(hits, AlertFold(micros(rule.window), rule.threshold), delay)
    else:
        hits = _picked(hits, AlertFold(_FOREVER, rule.threshold), delay, untimed=-_FOREVER // 2)
    return hits.withColumn("rule", F.lit(rule.name))


def anchored_windows_stream(df: DataFrame, window_seconds: float, delay: str = "1 minute") -> DataFrame:
    """Add ``window_start`` and ``window_end`` of windows that open at their first row, per source, in time order.

    Rows without a time are in no window; both are NULL there.
    """
    require(window_seconds > 0, "window_seconds must be positive")
    width = micros(window_seconds)
    fold = AnchorFold(width)

    def step(start, times, _):
        start, starts = fold.starts(start, times)
        return start, np.arange(len(times)), {"window_start": starts}

    windowed = _keyed(df, step, lambda start: start + width, delay, added=["window_start"])
    bounds = {name: F.timestamp_micros(F.col("window_start") + add) for name, add in (("window_start", 0), ("window_end", width))}
    windowed = windowed.select(*df.columns, *(bound.alias(name) for name, bound in bounds.items()))
    none = F.lit(None).cast("timestamp")
    return windowed.unionByName(df.where(F.col("ts").isNull()).withColumns({"window_start": none, "window_end": none}))


def dedup_count_stream(
    df: DataFrame, window_size: int = 256, max_repeats: int = 1, report: bool = False, delay: str = "1 minute"
) -> DataFrame:
    """The first ``max_repeats`` rows of each message, remembering ``window_size`` messages per source.

    In time order, rows without a time first. ``report`` gives the rows held back instead. Both add ``occurrence``.
    """
    require(window_size >= 1, "window_size must be >= 1")
    require(max_repeats >= 1, "max_repeats must be >= 1")
    fold = DedupFold(window_size, max_repeats, report)

    def step(seen, _, digests):
        seen, counts = fold.occurrences(seen, digests)
        counts = np.asarray(counts, np.int64)
        wanted = np.flatnonzero(counts > max_repeats if report else counts <= max_repeats)
        return seen, wanted, {"occurrence": counts[wanted]}

    digest = F.unhex(message_digest())
    return _keyed(df, step, lambda _: _FOREVER, delay, digest=digest, added=["occurrence"], untimed=-_FOREVER // 2)


def numbered_stream(df: DataFrame, column: str = "position", every: int = 1, delay: str = "1 minute") -> DataFrame:
    """Add the running number of each row in its source, in time order; keep every ``every``-th row only.

    Serves the index, the Nth sample and the reorder buffer: rows leave in time order, and numbers tell that order.
    """
    require(every >= 1, "every must be >= 1")

    def step(count, times, _):
        numbers = np.arange(1, len(times) + 1) + (count or 0)
        chosen = np.flatnonzero(numbers % every == 0)
        return int(numbers[-1]), chosen, {column: numbers[chosen]}

    return _keyed(df, step, lambda _: _FOREVER, delay, added=[column], untimed=-_FOREVER // 2)


def tee_stream(
    df: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, fail_fast: bool = True, **trigger
):
    """Start a query that hands every micro-batch and its number to all sinks.

    A batch may be repeated after a failure; a sink that overwrites a path named by the number writes it once.
    """

    def hand_on(batch: DataFrame, number: int) -> None:
        tee_logs(batch, {name: lambda rows, s=sink: s(rows, number) for name, sink in sinks.items()}, fail_fast)

    writer = df.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(hand_on).start()


def route_stream(df: DataFrame, routes: Sequence[Route], checkpoint: str, **trigger):
    """Start a query that hands every micro-batch's rows, and its number, to the sinks of the routes they take."""

    def hand_on(batch: DataFrame, number: int) -> None:
        numbered = [replace(r, sink=lambda rows, s=r.sink: s(rows, number)) if r.sink else r for r in routes]
        dispatch_routes(batch, numbered)

    writer = df.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(hand_on).start()
