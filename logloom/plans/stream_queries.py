"""Structured Streaming queries over the event log, run over all available input, closed, and run to their end.

Where a query takes ``_some_untimed`` rows, every tenth event loses its time, to show what becomes of such rows.
The sequential queries take along only the columns they decide on and give; rows that wait are held as they are.
"""

from pyspark.sql import functions as F

from logloom.checkpoints import scratch_path
from logloom.operators.rules import AlertRule, Route
from logloom.plans.registry import DENSE, EVENTS, PARSED, query
from logloom.sources.files import stream_logs
from logloom.sources.tables import dense_times, event_lines, event_logs_of
from logloom.streaming import operators as S

ID = ["source", "seq"]
_DAY = "1 day"
_UNTIMED = f"{EVENTS}, untimed AS (SELECT * FROM logs WHERE seq % 10 = 0), timed AS (SELECT * FROM logs WHERE seq % 10 <> 0)"


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return event_logs_of(spark.readStream.schema(schema).parquet(sf, pathGlobFilter="events.parquet"))


def _some_untimed(logs):
    return logs.withColumn("ts", F.when(F.col("seq") % 10 != 0, F.col("ts")))


def _complete(spark, rows, operator):
    """Run ``operator`` over the stream ``rows`` into a table until nothing waits, and read that."""
    path, state, end = (scratch_path(spark, name) for name in ("stream", "stream-state", "stream-end"))
    stream = operator(S.closable(rows, end))

    def start():
        writer = stream.writeStream.format("parquet").option("checkpointLocation", state)
        return writer.trigger(availableNow=True).start(path)

    S.run_closed(stream, start, end, rows.schema)
    return spark.read.schema(stream.schema).parquet(path)


def _hourly(spark, logs):
    done = _complete(spark, logs, lambda s: S.tumbling_counts_stream(s, 3600, _DAY, null_ts="keep"))
    return done.select("source", F.unix_micros("window_start").alias("window_start"), "level", "service", "total")


@query(f"""WITH {EVENTS} SELECT source, CAST(floor(epoch_us(ts) / 3.6e9) * 3600000000 AS BIGINT) AS window_start, level,
service, count(*) AS total FROM logs GROUP BY ALL""")
def stream_tumbling(spark, sf):
    return _hourly(spark, _events(spark, sf))


@query(f"""WITH {_UNTIMED} SELECT source, CAST(floor(epoch_us(ts) / 3.6e9) * 3600000000 AS BIGINT) AS window_start, level,
service, count(*) AS total FROM timed GROUP BY ALL
UNION ALL SELECT source, NULL, level, service, count(*) FROM untimed GROUP BY ALL""")
def stream_tumbling_untimed(spark, sf):
    """Rows without a time are counted under a NULL window."""
    return _hourly(spark, _some_untimed(_events(spark, sf)))


@query(f"WITH {EVENTS} SELECT DISTINCT source, level FROM logs")
def stream_dedup(spark, sf):
    logs = _events(spark, sf).select(*ID, "ts", "level", F.col("level").alias("message"))
    return _complete(spark, logs, lambda s: S.dedup_stream(s, "60 days")).select("source", "level")


@query(f"""WITH RECURSIVE {_UNTIMED},
r AS (SELECT source, seq, service AS g, epoch_us(ts) AS t, row_number() OVER (PARTITION BY source, service ORDER BY ts, seq) AS i
      FROM timed),
walk(source, g, seq, i, live, keep) AS (
  SELECT source, g, seq, i, [t], true FROM r WHERE i = 1
  UNION ALL
  SELECT r.source, r.g, r.seq, r.i,
         CASE WHEN len(list_filter(live, lambda x: x >= r.t - 36000000000)) < 2 THEN list_append(live, r.t)[-2:] ELSE live END,
         len(list_filter(live, lambda x: x >= r.t - 36000000000)) < 2
  FROM walk w JOIN r ON r.source = w.source AND r.g = w.g AND r.i = w.i + 1)
SELECT source, seq FROM walk WHERE keep UNION ALL SELECT source, seq FROM untimed""")
def stream_throttle(spark, sf):
    logs = _some_untimed(_events(spark, sf)).select(*ID, "ts", "service")
    return _complete(spark, logs, lambda s: S.throttle_stream(s, 36_000, 2, F.col("service"), _DAY)).select(*ID)


@query(f"""WITH RECURSIVE {_UNTIMED}, {DENSE},
r AS (SELECT source, seq, us AS t, row_number() OVER (PARTITION BY source ORDER BY us, seq) AS i FROM dense WHERE seq % 10 <> 0),
walk(source, seq, i, live, keep) AS (
  SELECT source, seq, i, [t], true FROM r WHERE i = 1
  UNION ALL
  SELECT r.source, r.seq, r.i,
         CASE WHEN len(list_filter(live, lambda x: x >= r.t - 1000000)) < 2 THEN list_append(live, r.t)[-2:] ELSE live END,
         len(list_filter(live, lambda x: x >= r.t - 1000000)) < 2
  FROM walk w JOIN r ON r.source = w.source AND r.i = w.i + 1)
SELECT source, seq FROM walk WHERE keep UNION ALL SELECT source, seq FROM untimed""")
def stream_rate_limit(spark, sf):
    logs = _some_untimed(dense_times(_events(spark, sf))).select(*ID, "ts")
    return _complete(spark, logs, lambda s: S.rate_limit_stream(s, 2, _DAY)).select(*ID)


@query(f"""WITH RECURSIVE {_UNTIMED},
r AS (SELECT source, seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY source ORDER BY ts, seq) AS i FROM timed
      WHERE level = 'error'),
walk(source, seq, i, hits, fired) AS (
  SELECT source, seq, i, [t], false FROM r WHERE i = 1
  UNION ALL
  SELECT source, seq, i, CASE WHEN len(h) >= 3 THEN CAST([] AS BIGINT[]) ELSE h END, len(h) >= 3
  FROM (SELECT r.source, r.seq, r.i, list_append(list_filter(hits, lambda x: x >= r.t - 14400000000), r.t) AS h
        FROM walk w JOIN r ON r.source = w.source AND r.i = w.i + 1))
SELECT source, seq, 'burst' AS rule FROM walk WHERE fired""")
def stream_alert(spark, sf):
    """Rows without a time do not count here, as in the batch operator."""
    rule = AlertRule("ERROR", threshold=3, window=14_400, name="burst")
    return _complete(spark, _some_untimed(_events(spark, sf)), lambda s: S.alert_stream(s, rule, _DAY)).select(*ID, "rule")


@query(f"""WITH {EVENTS} SELECT source, count(*) // 5 AS alerts FROM logs WHERE level = 'error' GROUP BY source""")
def stream_alert_unbounded(spark, sf):
    """Without a time limit every hit counts, whether it has a time or not."""
    rule = AlertRule("ERROR", threshold=5, window=0, name="fifth")
    fired = _complete(spark, _some_untimed(_events(spark, sf)), lambda s: S.alert_stream(s, rule, _DAY))
    return fired.groupBy("source").agg(F.count("*").alias("alerts"))


_TIMED_BY_SOURCE = "row_number() OVER (PARTITION BY source ORDER BY ts, seq) AS i"


@query(f"""WITH RECURSIVE {_UNTIMED}, r AS (SELECT source, seq, epoch_us(ts) AS t, {_TIMED_BY_SOURCE} FROM timed),
walk(source, seq, i, start) AS (
  SELECT source, seq, i, t FROM r WHERE i = 1
  UNION ALL
  SELECT r.source, r.seq, r.i, CASE WHEN r.t >= start + 20000000000 THEN r.t ELSE start END
  FROM walk w JOIN r ON r.source = w.source AND r.i = w.i + 1)
SELECT source, seq, start AS window_start FROM walk UNION ALL SELECT source, seq, NULL FROM untimed""")
def stream_anchored(spark, sf):
    logs = _some_untimed(_events(spark, sf)).select(*ID, "ts")
    windowed = _complete(spark, logs, lambda s: S.anchored_windows_stream(s, 20_000, _DAY))
    return windowed.select(*ID, F.unix_micros("window_start").alias("window_start"))


# The memory of messages: a list of (message, count) in the order of entry.
_MEMORY = f"""r AS (SELECT source, seq, k AS d, {_TIMED_BY_SOURCE} FROM logs),
walk(source, seq, i, seen, n) AS (
  SELECT source, seq, i, [{{'d': d, 'n': 1}}], 1 FROM r WHERE i = 1
  UNION ALL
  SELECT source, seq, i, CASE WHEN n = 1 AND len(seen) >= 40 THEN list_append(seen[2:], {{'d': d, 'n': 1}})
         WHEN n = 1 THEN list_append(seen, {{'d': d, 'n': 1}})
         ELSE list_transform(seen, lambda x: CASE WHEN x.d = d THEN {{'d': d, 'n': n}} ELSE x END) END, n
  FROM (SELECT r.source, r.seq, r.i, r.d, w.seen, coalesce(list_filter(w.seen, lambda x: x.d = r.d)[1].n, 0) + 1 AS n
        FROM walk w JOIN r ON r.source = w.source AND r.i = w.i + 1))"""


def _by_key(logs):
    return logs.select(*ID, "ts", F.element_at("extra", F.lit("k")).alias("message"))


@query(f"WITH RECURSIVE {EVENTS}, {_MEMORY} SELECT source, seq, CAST(n AS BIGINT) AS occurrence FROM walk WHERE n = 1")
def stream_dedup_count(spark, sf):
    passed = _complete(spark, _by_key(_events(spark, sf)), lambda s: S.dedup_count_stream(s, 40, delay=_DAY))
    return passed.select(*ID, "occurrence")


@query(f"WITH RECURSIVE {EVENTS}, {_MEMORY} SELECT source, seq, CAST(n AS BIGINT) AS occurrence FROM walk WHERE n > 1")
def stream_suppressed(spark, sf):
    held = _complete(spark, _by_key(_events(spark, sf)), lambda s: S.dedup_count_stream(s, 40, report=True, delay=_DAY))
    return held.select(*ID, "occurrence")


@query(f"WITH {EVENTS}, n AS (SELECT source, seq, {_TIMED_BY_SOURCE} FROM logs) SELECT source, seq, i AS position FROM n WHERE i % 7 = 0")
def stream_nth(spark, sf):
    chosen = _complete(spark, _events(spark, sf).select(*ID, "ts"), lambda s: S.numbered_stream(s, every=7, delay=_DAY))
    return chosen.select(*ID, "position")


@query(f"WITH {EVENTS} SELECT source, seq, {_TIMED_BY_SOURCE.replace(' AS i', ' AS position')} FROM logs")
def stream_sequence(spark, sf):
    """The running index; rows leave in time order, so it is the reordered feed, too."""
    return _complete(spark, _events(spark, sf).select(*ID, "ts"), lambda s: S.numbered_stream(s, delay=_DAY)).select(*ID, "position")


@query("SELECT count(*) AS n, count(*) AS ids FROM events")
def stream_ids(spark, sf):
    """Every line of a feed of several files has an id of its own."""
    path, out = scratch_path(spark, "feed"), scratch_path(spark, "feed-ids")
    event_lines(spark, sf).select("raw").repartition(5).write.text(path)
    feed = stream_logs(spark, path, source="feed", max_files_per_trigger=2).select("source", "seq")
    writer = feed.writeStream.option("checkpointLocation", scratch_path(spark, "feed-state"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    rows = spark.read.schema(feed.schema).parquet(out)
    return rows.agg(F.count("*").alias("n"), F.count_distinct("source", "seq").alias("ids"))


@query(f"WITH {PARSED} SELECT raw, level, is_json, message FROM logs")
def stream_files(spark, sf):
    """Lines written to a directory, followed as a stream, parsed, and handed to a sink per micro-batch."""
    path, out = scratch_path(spark, "feed"), scratch_path(spark, "followed")
    event_lines(spark, sf).select("raw").write.text(path)
    logs = stream_logs(spark, path, source="feed", max_files_per_trigger=1)

    def table(df, number):
        df.select("raw", "level", "is_json", "message").write.mode("overwrite").parquet(f"{out}/batch={number}")

    S.tee_stream(logs, {"table": table}, scratch_path(spark, "tee-state")).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query(f"""WITH {EVENTS} SELECT 'errors' AS route, source, seq FROM logs WHERE level = 'error'
UNION ALL SELECT 'rest', source, seq FROM logs WHERE level <> 'error'""")
def stream_routes(spark, sf):
    out = scratch_path(spark, "routed")

    def sink(name):
        return lambda df, number: df.select(*ID).write.mode("overwrite").parquet(f"{out}/route={name}/batch={number}")

    routes = [Route("errors", "level = 'error'", True, sink("errors")), Route("rest", "true", sink=sink("rest"))]
    S.route_stream(_events(spark, sf), routes, scratch_path(spark, "route-state")).awaitTermination()
    return spark.read.parquet(out).select("route", *ID)
