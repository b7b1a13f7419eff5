"""Counts over log rows: tumbling windows, statistics, top messages, correlation groups.

Every result is first counted by hash aggregation with partial counts in the map tasks, so a window, level
or key that holds most rows reaches the reducers as one row per map task. Maps are built from those counts.
"""

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.maps import counts_map
from logloom.functions.text import or_default
from logloom.operators.rules import require

TOP_MESSAGE_LENGTH = 120
UNKNOWN = "unknown"
MICROS = 1_000_000


def level_name() -> Column:
    return F.lower(or_default(F.col("level"), UNKNOWN))


def service_name() -> Column:
    """The service for statistics: the payload's ``service``, else its ``container``."""
    extra = F.col("extra")
    named = F.coalesce(*[F.nullif(F.element_at(extra, F.lit(k)), F.lit("")) for k in ("service", "container")])
    return F.coalesce(named, F.lit(UNKNOWN))


def with_event_time(df: DataFrame, null_ts: str) -> DataFrame:
    """What becomes of rows without a time: they stay so (``keep``), are left out (``drop``) or take the query's (``now``)."""
    require(null_ts in ("keep", "drop", "now"), "null_ts must be 'keep', 'drop' or 'now'")
    if null_ts == "now":
        # Taken once on the driver: every job of the query must see the same time.
        return df.withColumn("ts", F.coalesce("ts", F.lit(datetime.now(timezone.utc)).cast("timestamp")))
    return df.where(F.col("ts").isNotNull()) if null_ts == "drop" else df


def _with_window(df: DataFrame, window_seconds: int, null_ts: str) -> DataFrame:
    """Epoch-aligned ``window_start`` and ``window_end``; both are NULL where there is no time."""
    require(window_seconds > 0, "window_seconds must be positive")
    time, width = F.unix_micros(F.col("ts").cast("timestamp")), window_seconds * MICROS
    start = time - F.pmod(time, F.lit(width))
    return with_event_time(df, null_ts).withColumns(
        {"window_start": F.timestamp_micros(start), "window_end": F.timestamp_micros(start + width)}
    )


def tumbling_counts_long(df: DataFrame, window_seconds: int = 60, null_ts: str = "keep") -> DataFrame:
    """One row per source, epoch-aligned window, level and service with its count.

    Rows without a time are counted under a NULL window unless ``null_ts`` says otherwise.
    """
    level, service = level_name().alias("level"), or_default(F.col("service"), UNKNOWN).alias("service")
    windowed = _with_window(df, window_seconds, null_ts)
    return windowed.groupBy("source", "window_start", "window_end", level, service).agg(F.count("*").alias("total"))


def _count_maps(df: DataFrame, keys: Sequence[str], breakdowns: dict[str, Column], **extra: tuple) -> DataFrame:
    """Per ``keys`` a total and one map of counts per breakdown, in two shuffles.

    Every row is counted once per breakdown, with partial counts in the map tasks. ``extra`` names further results:
    (aggregate function, column), for functions that may be applied twice.
    """
    kinds = [F.struct(F.lit(name).alias("kind"), value.alias("value")) for name, value in breakdowns.items()]
    spread = df.select(*keys, *(c.alias(name) for name, (_, c) in extra.items()), F.explode(F.array(*kinds)).alias("_b"))
    counted = spread.groupBy(*keys, "_b.kind", "_b.value").agg(F.count("*").alias("n"), *(f(name).alias(name) for name, (f, _) in extra.items()))
    value, n, first = F.col("value"), F.col("n"), next(iter(breakdowns))
    return counted.groupBy(*keys).agg(
        F.sum(F.when(F.col("kind") == first, n)).alias("total"),
        *[counts_map(F.when(F.col("kind") == name, value), n).alias(name) for name in breakdowns],
        *(f(name).alias(name) for name, (f, _) in extra.items()),
    )


def tumbling_counts(df: DataFrame, window_seconds: int = 60, null_ts: str = "keep") -> DataFrame:
    """Per source and epoch-aligned window: total, counts by level and by service. Empty windows are absent."""
    windowed = _with_window(df, window_seconds, null_ts)
    names = {"by_level": level_name(), "by_service": or_default(F.col("service"), UNKNOWN)}
    return _count_maps(windowed, ["source", "window_start", "window_end"], names)


def bucket_line() -> Column:
    """``[HH:MM:SS-HH:MM:SS] total=n levels=(k=v, ...)`` of a row of :func:`tumbling_counts`."""
    pairs = F.transform(
        F.sort_array(F.map_entries("by_level")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    start, end = (F.date_format(c, "HH:mm:ss") for c in ("window_start", "window_end"))
    return F.format_string("[%s-%s] total=%d levels=(%s)", start, end, F.col("total"), F.array_join(pairs, ", "))


def stats(df: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Total, counts by level and by service, first and last time, per ``by`` (``()`` for the whole table)."""
    times = {"first_ts": (F.min, F.col("ts")), "last_ts": (F.max, F.col("ts"))}
    return _count_maps(df, list(by), {"by_level": level_name(), "by_service": service_name()}, **times)


def time_range(df: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    return df.groupBy(*by).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("total"))


def _top(counts: DataFrame, by: Sequence[str], n: int, ties: Sequence[str]) -> DataFrame:
    """The ``n`` largest counts per ``by``; with a rank when there is more than one group to report."""
    order = [F.desc("count"), *ties]
    if not by:
        return counts.orderBy(*order).limit(n)
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def breakdown(df: DataFrame, name: Column, column: str, by: Sequence[str] = ("source",), top: int | None = None):
    """Counts per value of ``name``, the ``top`` largest only if given; names break ties."""
    counts = df.groupBy(*by, name.alias(column)).agg(F.count("*").alias("count"))
    return counts if top is None else _top(counts, by, top, [column])


def level_breakdown(df: DataFrame, by: Sequence[str] = ("source",), top: int | None = None) -> DataFrame:
    return breakdown(df, level_name(), "level", by, top)


def service_breakdown(df: DataFrame, by: Sequence[str] = ("source",), top: int | None = None) -> DataFrame:
    return breakdown(df, service_name(), "service", by, top)


def top_messages(df: DataFrame, n: int = 5, by: Sequence[str] = ("source",)) -> DataFrame:
    """The most frequent messages, compared on their first 120 characters; the earliest seen wins a tie.

    Cutting the key is the feature here: long messages that start alike count as one.
    """
    key = F.substring("message", 1, TOP_MESSAGE_LENGTH).alias("message")
    first = F.min(F.struct("source", "seq"))
    counts = df.where(F.col("message") != "").groupBy(*by, key).agg(F.count("*").alias("count"), first.alias("_first"))
    return _top(counts, by, n, ["_first"]).drop("_first")


def correlation_key(field: str = "trace_id", window_seconds: float = 5.0) -> Column:
    """The value of ``extra[field]`` if that key exists, else a time slot, else ``ungrouped``."""
    require(window_seconds > 0, "window_seconds must be positive")
    extra = F.col("extra")
    named = F.when(
        F.map_contains_key(extra, F.lit(field)), F.coalesce(F.element_at(extra, F.lit(field)), F.lit("None"))
    )
    # A cast to integer cuts toward zero, also before 1970.
    slot = (F.unix_micros("ts") / F.lit(float(MICROS)) / F.lit(float(window_seconds))).cast("long")
    return F.coalesce(named, F.concat(F.lit("window:"), slot.cast("string")), F.lit("ungrouped"))


def with_correlation_key(df: DataFrame, field: str = "trace_id", window_seconds: float = 5.0) -> DataFrame:
    return df.withColumn("corr_key", correlation_key(field, window_seconds))


def correlation_groups(
    df: DataFrame, field: str = "trace_id", window_seconds: float = 5.0, min_group_size: int = 1
) -> DataFrame:
    """Per source and key: row count, counts by level as written, and the sorted distinct services."""
    require(min_group_size >= 1, "min_group_size must be >= 1")
    keyed = df.withColumn("key", correlation_key(field, window_seconds))
    names = {"levels": or_default(F.col("level"), UNKNOWN), "_services": F.nullif(F.col("service"), F.lit(""))}
    groups = _count_maps(keyed, ["source", "key"], names)
    return (
        groups.withColumn("services", F.sort_array(F.map_keys("_services")))
        .where(F.col("total") >= min_group_size)
        .select("source", "key", F.col("total").alias("count"), "levels", "services")
    )


def correlated_rows(
    df: DataFrame, field: str = "trace_id", window_seconds: float = 5.0, min_group_size: int = 1
) -> DataFrame:
    """The rows of every group of at least ``min_group_size``, with their key.

    The sizes are joined back from partial counts; a window over the group would put a large one in one task.
    """
    require(min_group_size >= 1, "min_group_size must be >= 1")
    keyed = with_correlation_key(df, field, window_seconds)
    if min_group_size == 1:
        return keyed
    small = keyed.groupBy("source", "corr_key").agg(F.count("*").alias("_n")).where(F.col("_n") < min_group_size)
    return keyed.join(small, ["source", "corr_key"], "left_anti").select(*keyed.columns)


def bucket_counts(df: DataFrame, bucket: str = "bucket", by: Sequence[str] = ()) -> DataFrame:
    """Rows per bucket in the order of their names."""
    return df.groupBy(*by, bucket).agg(F.count("*").alias("count")).orderBy(*by, bucket)


def match_count(df: DataFrame) -> DataFrame:
    """How many rows passed, as one row."""
    return df.agg(F.count("*").alias("matched"))
