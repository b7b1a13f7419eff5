"""Queries over sets of rows: aggregation, order-dependent operators, sampling."""

from pyspark.sql import functions as F

from logloom.operators import aggregate, ordered, stateful, tag
from logloom.operators.filters import level_equals
from logloom.operators.rules import AlertRule, SplitRule
from logloom.plans.registry import CONVERSATIONS, DENSE, DOCUMENTS, EVENTS, LINEITEM, ORDERS, query
from logloom.sources.tables import (
    TIMESTAMP_FORMAT,
    conversation_logs,
    dense_times,
    document_logs,
    event_logs,
    lineitem_logs,
    order_logs,
)

ID = ["source", "seq"]


def _us(column, name=None):
    return F.unix_micros(column).alias(name or column)


def _pairs(column):
    """A map as text, keys in order."""
    pairs = F.transform(
        F.sort_array(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return F.array_join(pairs, ", ").alias(column)


# Aggregation


@query(f"""WITH {EVENTS} SELECT source, CAST(floor(epoch_us(ts) / 3.6e9) * 3600000000 AS BIGINT) AS window_start,
level, service, count(*) AS total FROM logs GROUP BY ALL""")
def tumbling_counts(spark, sf):
    counts = aggregate.tumbling_counts_long(event_logs(spark, sf), 3600)
    return counts.select("source", _us("window_start"), "level", "service", "total")


@query(f"""WITH {EVENTS}, n AS (SELECT source, floor(epoch_us(ts) / 3.6e9) * 3600 AS start, level, count(*) AS n
FROM logs GROUP BY ALL)
SELECT source, '[' || strftime(make_timestamp(CAST(start * 1e6 AS BIGINT)), '%H:%M:%S') || '-'
|| strftime(make_timestamp(CAST((start + 3600) * 1e6 AS BIGINT)), '%H:%M:%S') || '] total=' || CAST(sum(n) AS BIGINT)
|| ' levels=(' || string_agg(level || '=' || n, ', ' ORDER BY level) || ')' AS line FROM n GROUP BY source, start""")
def tumbling_lines(spark, sf):
    return aggregate.tumbling_counts(event_logs(spark, sf), 3600).select("source", aggregate.bucket_line().alias("line"))


@query(f"""WITH {LINEITEM}, n AS (SELECT source, epoch_us(date_trunc('day', ts)) AS start, service, lower(level) AS level,
count(*) AS n FROM logs GROUP BY ALL), s AS (SELECT source, start, service, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY ALL),
l AS (SELECT source, start, level, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY ALL)
SELECT source, start AS window_start, (SELECT CAST(sum(n) AS BIGINT) FROM s WHERE s.source = t.source AND s.start = t.start) AS total,
(SELECT string_agg(level || '=' || n, ', ' ORDER BY level) FROM l WHERE l.source = t.source AND l.start = t.start) AS by_level,
(SELECT string_agg(service || '=' || n, ', ' ORDER BY service) FROM s WHERE s.source = t.source AND s.start = t.start)
AS by_service FROM (SELECT DISTINCT source, start FROM n) t""")
def tumbling_maps(spark, sf):
    counts = aggregate.tumbling_counts(lineitem_logs(spark, sf, numbered=False), 86_400)
    return counts.select("source", _us("window_start"), "total", _pairs("by_level"), _pairs("by_service"))


@query(f"""WITH {ORDERS}, l AS (SELECT source, lower(level) AS level, count(*) AS n FROM logs GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS total, string_agg(level || '=' || n, ', ' ORDER BY level) AS by_level,
'unknown=' || CAST(sum(n) AS BIGINT) AS by_service, (SELECT epoch_us(min(ts)) FROM logs WHERE logs.source = l.source) AS first_ts,
(SELECT epoch_us(max(ts)) FROM logs WHERE logs.source = l.source) AS last_ts FROM l GROUP BY source""")
def stats(spark, sf):
    totals = aggregate.stats(order_logs(spark, sf))
    return totals.select("source", "total", _pairs("by_level"), _pairs("by_service"), _us("first_ts"), _us("last_ts"))


@query(f"WITH {LINEITEM} SELECT lower(level) AS level, count(*) AS count FROM logs GROUP BY ALL")
def stats_level(spark, sf):
    return aggregate.level_breakdown(lineitem_logs(spark, sf, numbered=False), by=())


@query(f"""WITH {EVENTS}, n AS (SELECT source, service, count(*) AS count FROM logs GROUP BY ALL)
SELECT source, service, count FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY count DESC, service) <= 5""")
def stats_service(spark, sf):
    return aggregate.service_breakdown(event_logs(spark, sf), top=5)


@query(f"""WITH {DOCUMENTS}, n AS (SELECT source, substr(message, 1, 120) AS message, count(*) AS count, min(seq) AS first
FROM logs WHERE message <> '' GROUP BY ALL)
SELECT source, message, count FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY count DESC, first) <= 5""")
def top_messages(spark, sf):
    return aggregate.top_messages(document_logs(spark, sf))


@query(f"""WITH {LINEITEM} SELECT message, count(*) AS count FROM logs GROUP BY message
ORDER BY count DESC, min({{'source': source, 'seq': seq}}) LIMIT 20""")
def top_messages_overall(spark, sf):
    return aggregate.top_messages(lineitem_logs(spark, sf), 20, by=())


@query(f"""WITH {LINEITEM} SELECT source, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts, count(*) AS total
FROM logs GROUP BY source""")
def time_range(spark, sf):
    return aggregate.time_range(lineitem_logs(spark, sf, numbered=False)).select("source", _us("first_ts"), _us("last_ts"), "total")


@query(f"""WITH {CONVERSATIONS}, n AS (SELECT source, trace_id, level, count(*) AS n FROM logs GROUP BY ALL)
SELECT source, trace_id AS key, CAST(sum(n) AS BIGINT) AS count, string_agg(level || '=' || n, ', ' ORDER BY level) AS levels
FROM n GROUP BY source, trace_id HAVING sum(n) >= 3""")
def correlate(spark, sf):
    groups = aggregate.correlation_groups(conversation_logs(spark, sf), min_group_size=3)
    return groups.select("source", "key", "count", _pairs("levels"))


@query(f"""WITH {EVENTS}, keyed AS (SELECT *, 'window:' || CAST(trunc(epoch_us(ts) / 5.4e9) AS BIGINT) AS key FROM logs)
SELECT source, key, count(*) AS count, string_agg(DISTINCT service, ' ' ORDER BY service) AS services
FROM keyed GROUP BY source, key""")
def correlate_by_time(spark, sf):
    groups = aggregate.correlation_groups(event_logs(spark, sf), "absent", 5400)
    return groups.select("source", "key", "count", F.array_join("services", " ").alias("services"))


@query(f"""WITH {EVENTS} SELECT source, seq, k AS corr_key FROM logs
QUALIFY count(*) OVER (PARTITION BY source, k) >= 12""")
def correlated_rows(spark, sf):
    return aggregate.correlated_rows(event_logs(spark, sf), "k", min_group_size=12).select(*ID, "corr_key")


@query(f"""WITH {EVENTS} SELECT CASE WHEN level = 'error' THEN 'errors' WHEN contains(message, 'value 9') THEN 'nines'
ELSE 'default' END AS bucket, count(*) AS count FROM logs GROUP BY ALL""")
def split_counts(spark, sf):
    rules = [
        SplitRule("errors", F.col("level") == "error"),
        SplitRule("nines", F.contains("message", F.lit("value 9"))),
    ]
    return aggregate.bucket_counts(tag.split_logs(event_logs(spark, sf), rules))


@query(f"WITH {EVENTS} SELECT count(*) AS matched FROM logs WHERE level = 'signup'")
def match_count(spark, sf):
    return aggregate.match_count(level_equals(event_logs(spark, sf), "SIGNUP"))


# Numbering, tail and sampling


@query(f"""WITH {EVENTS} SELECT source, seq, message FROM logs
QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC) <= 100""")
def tail_n(spark, sf):
    return ordered.tail_logs(event_logs(spark, sf), 100).select(*ID, "message")


@query(f"WITH {LINEITEM} SELECT source, seq FROM logs QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) % 7 = 0")
def sample_nth(spark, sf):
    """``seq`` is sparse here."""
    return ordered.sample_nth(lineitem_logs(spark, sf), 7).select(*ID)


@query(f"""WITH {LINEITEM} SELECT source, seq FROM logs
WHERE CAST('0x' || substr(md5('42:' || source || ':' || seq), 1, 8) AS BIGINT) / 4294967296.0 < 0.1""")
def sample_rate(spark, sf):
    return ordered.sample_rate(lineitem_logs(spark, sf), 0.1, seed=42).select(*ID)


@query(f"""WITH {EVENTS} SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY seq) AS position FROM logs""")
def row_numbers(spark, sf):
    return ordered.with_row_number(event_logs(spark, sf), "position").select(*ID, "position")


@query(f"""WITH {LINEITEM} SELECT source, seq, row_number() OVER (ORDER BY source, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), seq) AS rank
FROM logs""")
def sort_logs(spark, sf):
    return ordered.with_rank(ordered.sort_logs(lineitem_logs(spark, sf)).select(*ID))


# Sequential operators. The SQL forms walk each source or key row by row with the state in a list.


@query(f"""WITH {DOCUMENTS}, keyed AS (SELECT source, seq, md5(trim(message, e' \\t\\n\\r')) AS d FROM logs)
SELECT source, seq FROM keyed QUALIFY row_number() OVER (PARTITION BY source, d ORDER BY seq) = 1""")
def dedup_exact(spark, sf):
    """A memory larger than any source's messages, so nothing is forgotten."""
    return stateful.dedup_logs(document_logs(spark, sf), window_size=1 << 20).select(*ID)


_BY_SOURCE = "row_number() OVER (PARTITION BY source ORDER BY seq) AS i"


# The memory of messages: a list of (message, count) in the order of entry; the first goes when there are more than 40.
_COUNTED = f"""r AS (SELECT source, seq, k AS d, {_BY_SOURCE} FROM logs),
walk(source, seq, i, seen, n) AS (
  SELECT source, seq, i, [{{'d': d, 'n': 1}}], 1 FROM r WHERE i = 1
  UNION ALL
  SELECT source, seq, i, CASE WHEN n = 1 AND len(seen) >= 40 THEN list_append(seen[2:], {{'d': d, 'n': 1}})
         WHEN n = 1 THEN list_append(seen, {{'d': d, 'n': 1}})
         ELSE list_transform(seen, lambda x: CASE WHEN x.d = d THEN {{'d': d, 'n': n}} ELSE x END) END, n
  FROM (SELECT r.source, r.seq, r.i, r.d, w.seen, coalesce(list_filter(w.seen, lambda x: x.d = r.d)[1].n, 0) + 1 AS n
        FROM walk w JOIN r ON r.source = w.source AND r.i = w.i + 1))"""


@query(f"WITH RECURSIVE {EVENTS}, {_COUNTED} SELECT source, seq, CAST(n AS BIGINT) AS occurrence FROM walk WHERE n > 1")
def dedup_suppressed(spark, sf):
    logs = event_logs(spark, sf).withColumn("message", F.element_at("extra", F.lit("k")))
    return stateful.suppressed_logs(logs, window_size=40).select(*ID, "occurrence")


@query(f"""WITH RECURSIVE {EVENTS}, r AS (SELECT source, seq, k AS d, {_BY_SOURCE} FROM logs),
walk(source, seq, i, seen, keep) AS (
  SELECT source, seq, i, [d], true FROM r WHERE i = 1
  UNION ALL
  SELECT r.source, r.seq, r.i, CASE WHEN list_contains(seen, d) THEN seen WHEN len(seen) >= 40 THEN list_append(seen[2:], d)
         ELSE list_append(seen, d) END, NOT list_contains(seen, d)
  FROM walk w JOIN r ON r.source = w.source AND r.i = w.i + 1)
SELECT source, seq FROM walk WHERE keep""")
def dedup_bounded(spark, sf):
    logs = event_logs(spark, sf).withColumn("message", F.element_at("extra", F.lit("k")))
    return stateful.dedup_logs(logs, window_size=40).select(*ID)


@query(f"""WITH RECURSIVE {EVENTS},
r AS (SELECT source, seq, service AS g, epoch_us(ts) AS t, row_number() OVER (PARTITION BY source, service ORDER BY ts, seq) AS i
      FROM logs),
walk(source, g, seq, i, live, keep) AS (
  SELECT source, g, seq, i, [t], true FROM r WHERE i = 1
  UNION ALL
  SELECT r.source, r.g, r.seq, r.i,
         CASE WHEN len(list_filter(live, lambda x: x >= r.t - 36000000000)) < 2 THEN list_append(live, r.t)[-2:] ELSE live END,
         len(list_filter(live, lambda x: x >= r.t - 36000000000)) < 2
  FROM walk w JOIN r ON r.source = w.source AND r.g = w.g AND r.i = w.i + 1)
SELECT source, seq FROM walk WHERE keep""")
def throttle(spark, sf):
    return stateful.throttle_logs(event_logs(spark, sf), 36_000, 2, key=F.col("service")).select(*ID)


@query(f"""WITH RECURSIVE {EVENTS},
r AS (SELECT source, seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY source ORDER BY ts, seq) AS i FROM logs),
walk(source, seq, i, last, keep) AS (
  SELECT source, seq, i, t, true FROM r WHERE i = 1
  UNION ALL
  SELECT r.source, r.seq, r.i, CASE WHEN r.t > last + 5400000000 THEN r.t ELSE last END, r.t > last + 5400000000
  FROM walk w JOIN r ON r.source = w.source AND r.i = w.i + 1)
SELECT source, seq FROM walk WHERE keep""")
def throttle_source(spark, sf):
    """One key per source, with many more rows than pass."""
    return stateful.throttle_logs(event_logs(spark, sf), 5400, key=F.lit("all")).select(*ID)


@query(f"""WITH RECURSIVE {EVENTS}, {DENSE},
r AS (SELECT source, seq, us AS t, row_number() OVER (PARTITION BY source ORDER BY us, seq) AS i FROM dense),
walk(source, seq, i, live, keep) AS (
  SELECT source, seq, i, [t], true FROM r WHERE i = 1
  UNION ALL
  SELECT r.source, r.seq, r.i,
         CASE WHEN len(list_filter(live, lambda x: x >= r.t - 1000000)) < 2 THEN list_append(live, r.t)[-2:] ELSE live END,
         len(list_filter(live, lambda x: x >= r.t - 1000000)) < 2
  FROM walk w JOIN r ON r.source = w.source AND r.i = w.i + 1)
SELECT source, seq FROM walk WHERE keep""")
def rate_limit(spark, sf):
    """Several rows a second, so that the second slides and rows are dropped. 1.5 per second pass 2."""
    return stateful.rate_limit_logs(dense_times(event_logs(spark, sf)), 1.5).select(*ID)


_ERRORS = "errors AS (SELECT * FROM logs WHERE level = 'error')"


@query(f"WITH {EVENTS}, {_ERRORS} SELECT source, seq, 'each' AS rule FROM errors WHERE contains(message, '7')")
def alert_each(spark, sf):
    rule = AlertRule("ERROR", "7", threshold=1, name="each")
    return stateful.alert_logs(event_logs(spark, sf), [rule]).select(*ID, "rule")


@query(f"""WITH {EVENTS}, {_ERRORS} SELECT source, seq, 'fifth' AS rule FROM errors
QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) % 5 = 0""")
def alert_unbounded(spark, sf):
    rule = AlertRule("ERROR", threshold=5, window=0, name="fifth")
    return stateful.alert_logs(event_logs(spark, sf), [rule]).select(*ID, "rule")


@query(f"""WITH {EVENTS}, {_ERRORS}
SELECT source, seq, 'each' AS rule FROM errors WHERE contains(message, '7')
UNION ALL SELECT source, seq, 'fifth' FROM (SELECT * FROM errors QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) % 5 = 0)
UNION ALL SELECT source, seq, 'third' FROM
  (SELECT * FROM logs WHERE level = 'click' QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) % 3 = 0)""")
def alert_rules(spark, sf):
    """Several rules in one pass; they do not see each other's hits."""
    rules = [
        AlertRule("ERROR", "7", threshold=1, name="each"),
        AlertRule("ERROR", threshold=5, window=0, name="fifth"),
        AlertRule("click", threshold=3, window=0, name="third"),
    ]
    return stateful.alert_logs(event_logs(spark, sf), rules).select(*ID, "rule")


@query(f"""WITH RECURSIVE {EVENTS}, {_ERRORS},
r AS (SELECT source, seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY source ORDER BY ts, seq) AS i FROM errors),
walk(source, seq, i, hits, fired) AS (
  SELECT source, seq, i, [t], false FROM r WHERE i = 1
  UNION ALL
  SELECT source, seq, i, CASE WHEN len(h) >= 3 THEN CAST([] AS BIGINT[]) ELSE h END, len(h) >= 3
  FROM (SELECT r.source, r.seq, r.i, list_append(list_filter(hits, lambda x: x >= r.t - 14400000000), r.t) AS h
        FROM walk w JOIN r ON r.source = w.source AND r.i = w.i + 1))
SELECT source, seq, 'burst' AS rule FROM walk WHERE fired""")
def alert_window(spark, sf):
    rule = AlertRule("error", threshold=3, window=14_400, name="burst")
    return stateful.alert_logs(event_logs(spark, sf), [rule]).select(*ID, "rule")


_ANCHORED = f"""{EVENTS}, r AS (SELECT source, seq, level, epoch_us(ts) AS t, {_BY_SOURCE} FROM logs),
walk(source, seq, level, i, start) AS (
  SELECT source, seq, level, i, t FROM r WHERE i = 1
  UNION ALL
  SELECT r.source, r.seq, r.level, r.i, CASE WHEN r.t >= start + 20000000000 THEN r.t ELSE start END
  FROM walk w JOIN r ON r.source = w.source AND r.i = w.i + 1)"""


@query(f"""WITH RECURSIVE {_ANCHORED}
SELECT source, seq, start AS window_start, start + 20000000000 AS window_end FROM walk""")
def anchored_windows(spark, sf):
    windowed = stateful.anchored_windows(event_logs(spark, sf), 20_000)
    return windowed.select(*ID, _us("window_start"), _us("window_end"))


@query(f"""WITH RECURSIVE {_ANCHORED},
n AS (SELECT source, start, level, count(*) AS n FROM walk GROUP BY ALL)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY start) AS window_id, start AS window_start,
CAST(sum(n) AS BIGINT) AS total, string_agg(level || '=' || n, ', ' ORDER BY level) AS levels FROM n GROUP BY source, start""")
def window_summaries(spark, sf):
    summaries = stateful.window_summaries(stateful.anchored_windows(event_logs(spark, sf), 20_000))
    number = F.col("window_id").cast("long").alias("window_id")
    return summaries.select("source", number, _us("window_start"), "total", _pairs("levels"))


# Arrival order by amount, so that times are far out of order.
_SHUFFLED = """logs AS (SELECT 'c' || (user_id % 8) AS source, CAST(round(value * 100) AS BIGINT) * 10000000 + event_id AS seq,
strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp FROM events)"""


@query(f"""WITH RECURSIVE {_SHUFFLED}, r AS (SELECT source, {{'t': timestamp, 's': seq}} AS x, {_BY_SOURCE},
count(*) OVER (PARTITION BY source) AS n FROM logs),
walk(source, i, buffer, gone) AS (
  SELECT source, i, [x], CAST(NULL AS STRUCT(t VARCHAR, s BIGINT)) FROM r WHERE i = 1
  UNION ALL
  SELECT source, i, CASE WHEN len(b) > 20 THEN b[2:] ELSE b END, CASE WHEN len(b) > 20 THEN b[1] END
  FROM (SELECT r.source, r.i, list_sort(list_append(buffer, r.x)) AS b
        FROM walk w JOIN r ON r.source = w.source AND r.i = w.i + 1)),
rest AS (SELECT walk.source, unnest(buffer) AS x, i - len(buffer) + unnest(range(1, len(buffer) + 1)) AS position
         FROM walk JOIN (SELECT source, max(i) AS i FROM r GROUP BY source) e USING (source, i))
SELECT source, gone.s AS seq, i - 20 AS position FROM walk WHERE gone IS NOT NULL
UNION ALL SELECT source, x.s, position FROM rest""")
def sequence(spark, sf):
    arrival = F.round(F.col("value") * 100).cast("long") * 10_000_000 + F.col("event_id")
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = F.concat(F.lit("c"), (F.col("user_id") % 8).cast("string")).alias("source")
    logs = events.select(source, arrival.alias("seq"), F.date_format("ts", TIMESTAMP_FORMAT).alias("timestamp"))
    return stateful.sequence_logs(logs, 20).select(*ID, "position")
