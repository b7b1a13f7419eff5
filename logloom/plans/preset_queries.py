"""The presets over the event log as raw lines."""

from pyspark.sql import functions as F

from logloom.operators.aggregate import match_count
from logloom.plans import presets
from logloom.plans.registry import LINES, PARSED, PLAIN_LINE, TEXT_LINE, parsed_tail, query
from logloom.sources.tables import event_lines

ID = ["source", "seq"]
OUT = [*ID, "line"]


@query(f"""WITH {parsed_tail(100)}, hits AS (SELECT *, regexp_replace(message, '(value 1)', '<mark>\\1</mark>', 'gi') AS m
FROM logs WHERE level = 'click' AND contains(lower(message), 'value 1'))
SELECT source, seq, {PLAIN_LINE.replace("|| message", "|| m")} AS line FROM hits""")
def preset_browse(spark, sf):
    return presets.browse(event_lines(spark, sf), level="click", search="VALUE 1", mark=True).select(*OUT)


@query(f"WITH {parsed_tail(200)} SELECT source, seq, timestamp, level, message, raw FROM logs WHERE contains(message, 'e 3')")
def preset_export(spark, sf):
    return presets.export(event_lines(spark, sf), search="E 3").select(*ID, "timestamp", "level", "message", "raw")


@query(f"""WITH {parsed_tail(500)} SELECT source, count(*) AS total, epoch_us(min(ts)) AS first_ts,
epoch_us(max(ts)) AS last_ts, CAST(count(*) FILTER (level IS NULL) AS BIGINT) AS unknown FROM logs GROUP BY source""")
def preset_stats(spark, sf):
    stats = presets.stats(event_lines(spark, sf))
    unknown = F.coalesce(F.element_at("by_level", F.lit("unknown")), F.lit(0)).alias("unknown")
    first, last = F.unix_micros("first_ts").alias("first_ts"), F.unix_micros("last_ts").alias("last_ts")
    return stats.select("source", "total", first, last, unknown)


@query(f"""WITH {parsed_tail(500)}, n AS (
SELECT source, 'level' AS kind, lower(coalesce(level, 'unknown')) AS value, count(*) AS count FROM logs GROUP BY ALL
UNION ALL SELECT source, 'service', coalesce(service, 'unknown'), count(*) FROM logs GROUP BY ALL)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source, kind ORDER BY count DESC, value) <= 3""")
def preset_stats_top(spark, sf):
    return presets.stats_top(event_lines(spark, sf), top=3)


@query(f"""WITH {parsed_tail(500)}, n AS (SELECT source, message, count(*) AS count, min(seq) AS first FROM logs GROUP BY ALL)
SELECT source, message, count FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY count DESC, first) <= 3""")
def preset_top_messages(spark, sf):
    return presets.top_messages(event_lines(spark, sf), top=3)


@query(f"""WITH {PARSED} SELECT source, seq, 'buys' AS rule FROM logs WHERE level = 'purchase'
QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) % 10 = 0""")
def preset_alert(spark, sf):
    alerts = presets.alert(event_lines(spark, sf), "PURCHASE", threshold=10, window=0, rule_name="buys")
    return alerts.select(*ID, "rule")


@query(f"WITH {PARSED} SELECT source, seq, {TEXT_LINE} AS line FROM logs WHERE level = 'view' AND contains(message, '42')")
def preset_replay(spark, sf):
    return presets.replay(event_lines(spark, sf), level="view", exact="42").select(*OUT)


@query(f"WITH {PARSED} SELECT source, seq, {PLAIN_LINE} AS line FROM logs WHERE level = 'view' AND contains(message, '42')")
def preset_replay_plain(spark, sf):
    return presets.replay(event_lines(spark, sf), level="view", exact="42", plain=True).select(*OUT)


@query(f"WITH {PARSED} SELECT count(*) AS matched FROM logs WHERE level = 'view' AND contains(message, '42')")
def preset_replay_count(spark, sf):
    return match_count(presets.replay(event_lines(spark, sf), level="view", exact="42"))


@query(f"""WITH {parsed_tail(100)} SELECT source, seq, {PLAIN_LINE} AS line FROM logs WHERE level = 'signup'
QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) % 3 = 0""")
def preset_sample(spark, sf):
    return presets.sample(event_lines(spark, sf), every_nth=3, level="signup").select(*OUT)


@query(f"""WITH {parsed_tail(1000)} SELECT source, seq FROM logs WHERE contains(message, 'value 1')
QUALIFY row_number() OVER (PARTITION BY source, message ORDER BY seq) = 1""")
def preset_dedup(spark, sf):
    found = presets.dedup(event_lines(spark, sf), window=100_000, search="value 1", tail=1000)
    return found.select(*ID)


# Lines whose text is their level only, so that messages repeat.
_LEVELS = """said AS (SELECT source, seq, coalesce(level, 'plain') AS message FROM logs),
nth AS (SELECT *, row_number() OVER (PARTITION BY source, message ORDER BY seq) AS occurrence FROM said)"""


def _level_lines(spark, sf):
    level = F.coalesce(F.get_json_object(F.regexp_extract("raw", r"(\{.*)", 1), "$.level"), F.lit("plain"))
    return event_lines(spark, sf).withColumn("raw", F.concat(F.regexp_extract("raw", r"^(\S+ )", 1), level))


@query(f"WITH {parsed_tail(300)}, {_LEVELS} SELECT source, seq FROM nth WHERE occurrence <= 2")
def preset_dedup_levels(spark, sf):
    return presets.dedup(_level_lines(spark, sf), max_repeats=2, tail=300).select(*ID)


@query(f"WITH {parsed_tail(300)}, {_LEVELS} SELECT source, seq, occurrence FROM nth WHERE occurrence > 2")
def preset_dedup_report(spark, sf):
    return presets.dedup_report(_level_lines(spark, sf), max_repeats=2, tail=300).select(*ID, "occurrence")


@query(f"""WITH {parsed_tail(200)}, n AS (SELECT source, floor(epoch_us(ts) / 8.64e10) * 86400 AS start,
coalesce(level, 'unknown') AS level, count(*) AS n FROM logs GROUP BY ALL)
SELECT source, '[00:00:00-00:00:00] total=' || CAST(sum(n) AS BIGINT) || ' levels=('
|| string_agg(level || '=' || n, ', ' ORDER BY level) || ')' AS line FROM n GROUP BY source, start""")
def preset_aggregate(spark, sf):
    return presets.aggregate_windows(event_lines(spark, sf), 86_400).select("source", "line")


@query(f"""WITH {parsed_tail(100)} SELECT source, seq, regexp_replace(regexp_replace(message, '[0-9]+', '[REDACTED]', 'g'),
'value', 'v:', 'gi') AS message, regexp_replace(service, 'user', 'u', 'gi') AS service FROM logs""")
def preset_transform(spark, sf):
    replace = ["message:VALUE:v:", "service:user:u"]
    return presets.transform(event_lines(spark, sf), ["[0-9]+"], replace).select(*ID, "message", "service")


@query(f"""WITH {parsed_tail(200)} SELECT source, coalesce(k, 'window:' || CAST(floor(epoch_us(ts) / 5e6) AS BIGINT)) AS key,
count(*) AS count FROM logs GROUP BY ALL HAVING count(*) >= 2""")
def preset_correlate(spark, sf):
    return presets.correlate(event_lines(spark, sf), "k").select("source", "key", "count")


@query(f"""WITH {parsed_tail(100)} SELECT source, seq, {PLAIN_LINE} || CASE WHEN contains(message, 'value 2') THEN ' [two=Value 2]'
ELSE '' END AS line FROM logs WHERE level IS NULL""")
def preset_annotate(spark, sf):
    """Plain lines only have the tags themselves to show."""
    logs = presets.annotate(event_lines(spark, sf), ["two:Value 2", "x: never there"])
    return logs.where(F.col("level").isNull()).select(*OUT)


@query(f"""WITH {parsed_tail(500)} SELECT source, seq FROM logs
QUALIFY row_number() OVER (PARTITION BY source, date_trunc('day', ts) ORDER BY seq) <= 10""")
def preset_rate_limit(spark, sf):
    """All times of a day become its first second, so that rows are dropped."""
    lines = event_lines(spark, sf).withColumn("raw", F.regexp_replace("raw", r"^(.{10})T[0-9:.]+Z", "$1T00:00:00Z"))
    return presets.rate_limit(lines, tail=500).select(*ID)


@query(f"""WITH {parsed_tail(100)}, hits AS (
SELECT *, 'nine' AS route FROM logs WHERE contains(message, '9')
UNION ALL SELECT *, 'views' FROM logs WHERE level = 'view' AND NOT contains(message, '9'))
SELECT source, seq, '[' || route || '] ' || {PLAIN_LINE} AS line FROM hits""")
def preset_route(spark, sf):
    return presets.route(event_lines(spark, sf), ["nine:9"], ["views:VIEW"], stop=True).select(*OUT)


@query(f"""WITH {parsed_tail(100)} SELECT source, seq, CASE WHEN level = 'view' THEN 'view' WHEN contains(message, 'value 2')
THEN 'value 2' ELSE 'other' END AS bucket FROM logs""")
def preset_split(spark, sf):
    return presets.split(event_lines(spark, sf), ["View"], ["Value 2"], "other").select(*ID, "bucket")


@query(f"""WITH {parsed_tail(100)} SELECT source, seq, source AS host, CAST(row_number() OVER (PARTITION BY source ORDER BY seq)
AS VARCHAR) AS index FROM logs WHERE level = 'click'""")
def preset_enrich(spark, sf):
    logs = presets.enrich(event_lines(spark, sf), add_index=True, level="click")
    return logs.select(*ID, *[F.element_at("extra", F.lit(k)).alias(k) for k in ("host", "index")])


@query(f"WITH {parsed_tail(100)} SELECT source, seq, '<hidden>' AS message, '<hidden>' AS k FROM logs WHERE level = 'view'")
def preset_mask(spark, sf):
    logs = presets.mask(event_lines(spark, sf), ["message", "k"], "<hidden>", level="VIEW")
    return logs.select(*ID, "message", F.element_at("extra", F.lit("k")).alias("k"))


@query(f"""WITH {parsed_tail(100)} SELECT source, seq, '[' || CASE WHEN contains(message, 'value 1') THEN 'one'
WHEN contains(message, '2') THEN 'two' ELSE 'none' END || '] ' || {TEXT_LINE} AS line FROM logs""")
def preset_classify(spark, sf):
    keywords = ["one: VALUE 1 ", "two:2"]
    return presets.classify(event_lines(spark, sf), keywords, "none").select(*OUT)


@query(f"""WITH {LINES}, late AS (SELECT source, 1000000000 - seq AS seq, raw FROM lines),
recent AS (SELECT * FROM late QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC) <= 200)
SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY substr(raw, 1, 27), seq) AS position FROM recent""")
def preset_sequence(spark, sf):
    """Lines that arrive last first, through a buffer that holds them all."""
    lines = event_lines(spark, sf).withColumn("seq", 1_000_000_000 - F.col("seq"))
    return presets.sequence(lines, buffer=200).select(*ID, "position")


@query(f"WITH {parsed_tail(50)} SELECT source, seq, {PLAIN_LINE} AS line FROM logs WHERE level = 'purchase'")
def preset_tail(spark, sf):
    return presets.tail(event_lines(spark, sf), 50, level="purchase").select(*OUT)


@query(f"WITH {LINES} SELECT source, count(*) AS n FROM lines GROUP BY source")
def preset_tail_all(spark, sf):
    return presets.tail(event_lines(spark, sf)).groupBy("source").agg(F.count("*").alias("n"))
