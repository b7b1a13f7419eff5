"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (session, table directory) under its own name."""

    def register(build: Query) -> Query:
        @wraps(build)
        def in_utc(spark: SparkSession, directory: str) -> DataFrame:
            # The tables' times have no zone; they are read as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, directory)

        QUERIES[build.__name__] = in_utc
        if sql is not None:
            ORACLES[build.__name__] = sql
        return in_utc

    return register


# The tables as log rows, in SQL.
EVENTS = """logs AS (
  SELECT 'c' || (user_id % 8) AS source, event_id AS seq, ts, event_type AS level, 'user-' || user_id AS service,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, json_extract_string(props, '$.k') AS k,
         event_type || ' value ' || CAST(value AS VARCHAR) AS message
  FROM events)"""
# The same events 5,000 times as close together, so that a source has several rows in a second.
DENSE = "dense AS (SELECT * EXCLUDE (ts), epoch_us(ts) // 5000 AS us FROM logs)"
DOCUMENTS = "logs AS (SELECT source, doc_id AS seq, lang AS service, text AS message FROM documents)"
CONVERSATIONS = """logs AS (
  SELECT 'conv' || (conv_id % 4) AS source, (conv_id << 32) + turn AS seq, role AS level, text AS message,
         CAST(conv_id AS VARCHAR) AS trace_id
  FROM conversations)"""
PAGES = "logs AS (SELECT 'pages' AS source, page_id AS seq, url AS service, html AS message FROM pages)"
LINEITEM = """logs AS (
  SELECT 'supplier-' || (l_suppkey % 16) AS source, (l_orderkey * 8 + l_linenumber) * 1099511627776 + l_partkey * 65536 + l_suppkey AS seq, l_shipdate AS ts,
         l_returnflag AS level, l_linestatus AS service, 'part ' || l_partkey AS message
  FROM lineitem)"""
ORDERS = """logs AS (
  SELECT 'status-' || o_orderstatus AS source, o_orderkey AS seq, o_orderdate AS ts, o_orderpriority AS level,
         'priority ' || o_orderpriority AS message
  FROM orders)"""
# Events as raw lines, and those lines parsed again.
LINES = """lines AS (
  SELECT 'c' || (user_id % 8) AS source, event_id AS seq,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || ' ' || CASE WHEN event_type = 'error'
           THEN 'ERROR value ' || CAST(value AS VARCHAR)
           ELSE '{"level":"' || event_type || '","service":"user-' || user_id || '","msg":"' || event_type || ' value '
                || CAST(value AS VARCHAR) || '","k":"' || json_extract_string(props, '$.k') || '"}' END AS raw
  FROM events)"""
# The line pattern is a fixed value, as in operators/parse.py.
_BODY = r"""body AS (
  SELECT *, regexp_extract(raw, '^(\d{4}-\d{2}-\d{2}T[\d:.]+Z)\s+(.+)$', 1) AS timestamp,
         regexp_extract(raw, '^(\d{4}-\d{2}-\d{2}T[\d:.]+Z)\s+(.+)$', 2) AS body
  FROM @lines),
logs AS (
  SELECT source, seq, raw, timestamp, CAST(replace(timestamp, 'Z', '') AS TIMESTAMP) AS ts,
         body LIKE '{%}' AS is_json,
         CASE WHEN body LIKE '{%}' THEN json_extract_string(body, '$.level') END AS level,
         CASE WHEN body LIKE '{%}' THEN json_extract_string(body, '$.service') END AS service,
         CASE WHEN body LIKE '{%}' THEN json_extract_string(body, '$.k') END AS k,
         CASE WHEN body LIKE '{%}' THEN json_extract_string(body, '$.msg') ELSE body END AS message
  FROM body)"""
PARSED = LINES + ",\n" + _BODY.replace("@lines", "lines")
PLAIN_LINE = (
    "timestamp || '  ' || CASE WHEN length(coalesce(level, 'UNKNOWN')) < 7 "
    "THEN rpad(upper(coalesce(level, 'UNKNOWN')), 7, ' ') ELSE upper(coalesce(level, 'UNKNOWN')) END || '  ' || message"
)
TEXT_LINE = "'[' || timestamp || '] ' || message"


def parsed_tail(n: int) -> str:
    """The last ``n`` raw lines of each source, parsed."""
    recent = f"recent AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC) <= {n})"
    return LINES + ",\n" + recent + ",\n" + _BODY.replace("@lines", "recent")
