"""Operators whose decision on a row depends on earlier decisions: throttle, rate limit, alerts, anchored
windows, bounded duplicate filter, bounded reordering.

Each one decides on narrow rows with :mod:`logloom.operators.chunked` and joins the decisions back to the
full rows on ``(source, seq)``, which no key can skew. Time is event time. Rows without a time cannot be
placed in a window: throttle and rate limit let them pass, alerts with a time limit do not count them.
"""

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.checkpoints import materialize
from logloom.functions.maps import counts_map
from logloom.functions.text import contains_ci, equals_ci, strip
from logloom.operators.aggregate import MICROS, level_name, with_event_time
from logloom.operators.chunked import chunked_fold
from logloom.operators.folds import AlertFold, AnchorFold, DedupFold, ReorderFold, RuleFolds, ThrottleFold
from logloom.operators.ordered import with_row_number
from logloom.operators.rules import AlertRule, require
from logloom.schema import ROW_ID

_IDS = "source string, seq long"


def micros(seconds: float) -> int:
    return round(seconds * MICROS)


def _timed(df: DataFrame) -> DataFrame:
    return df.where(F.col("ts").isNotNull()).withColumn("t", F.unix_micros("ts"))


def _keep(df: DataFrame, passed: DataFrame) -> DataFrame:
    return df.join(passed, ROW_ID, "left_semi").select(*df.columns)


def message_digest() -> Column:
    """Messages are compared by the MD5 of their stripped text."""
    return F.md5(F.encode(strip(F.coalesce("message", F.lit(""))), "UTF-8"))


def throttle_logs(
    df: DataFrame,
    window_seconds: float,
    max_allowed: int = 1,
    key: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Per source and ``key`` (the message by default), at most ``max_allowed`` rows in any closed time window.

    Dropped rows do not count toward the limit.
    """
    require(window_seconds > 0, "window_seconds must be positive")
    require(max_allowed >= 1, "max_allowed must be >= 1")
    text = F.coalesce(F.col("message") if key is None else key.cast("string"), F.lit(""))
    narrow = _timed(df).select(*ROW_ID, "t", F.md5(F.encode(text, "UTF-8")).alias("digest"))
    fold = ThrottleFold(micros(window_seconds), max_allowed)
    passed = chunked_fold(
        narrow,
        F.concat_ws("\n", "digest", "source"),
        ["t", "seq"],
        fold,
        _IDS,
        partitions,
    )
    return _keep(df, passed.unionByName(df.where(F.col("ts").isNull()).select(*ROW_ID)))


def rate_limit_logs(df: DataFrame, max_per_second: float, partitions: int | None = None) -> DataFrame:
    """Per source, at most ``max_per_second`` rows in any closed second; a fraction counts as one more row."""
    require(max_per_second > 0, "max_per_second must be positive")
    fold = ThrottleFold(MICROS, math.ceil(max_per_second))
    passed = chunked_fold(
        _timed(df).select(*ROW_ID, "t"), F.col("source"), ["t", "seq"], fold, _IDS, partitions
    )
    return _keep(df, passed.unionByName(df.where(F.col("ts").isNull()).select(*ROW_ID)))


def alert_hits(rule: AlertRule) -> Column:
    hit = equals_ci(F.col("level"), rule.level)
    return hit & contains_ci(F.col("message"), rule.keyword) if rule.keyword else hit


def alert_logs(df: DataFrame, rules: Sequence[AlertRule], partitions: int | None = None) -> DataFrame:
    """The rows on which each rule fires, with the rule's name. Rules are independent; sources too.

    One pass finds the hits of all rules; then hits of rules with a time limit are folded, and those of the others numbered, all rules together.
    """
    require(bool(rules), "at least one rule is needed")
    hit = F.array_compact(F.array(*(F.when(alert_hits(rule), F.lit(i)) for i, rule in enumerate(rules))))
    hits = df.withColumn("_rule", F.explode(hit))

    def of(wanted) -> tuple[DataFrame, list[int]]:
        numbers = [i for i, rule in enumerate(rules) if wanted(rule)]
        return hits.where(F.col("_rule").isin(numbers)), numbers

    parts = []
    each, numbers = of(lambda r: r.threshold == 1)
    if numbers:
        parts.append(each)
    counted, numbers = of(lambda r: r.threshold > 1 and r.window == 0)
    if numbers:
        every = F.create_map(*(F.lit(x) for i in numbers for x in (i, rules[i].threshold)))
        numbered = with_row_number(counted, "_hit", ["source", "_rule"])
        parts.append(numbered.where(F.col("_hit") % every[F.col("_rule")] == 0).drop("_hit"))
    limited, numbers = of(lambda r: r.threshold > 1 and r.window > 0)
    if numbers:
        folds = {i: AlertFold(micros(rules[i].window), rules[i].threshold) for i in numbers}
        narrow = _timed(limited).select(*ROW_ID, "t", F.col("_rule").alias("rule"))
        key = F.concat_ws("\n", F.col("rule").cast("string"), "source")
        fired = chunked_fold(narrow, key, ["t", "seq"], RuleFolds(folds), f"{_IDS}, rule int", partitions)
        same = [*ROW_ID, "_rule"]
        parts.append(limited.join(fired.withColumnRenamed("rule", "_rule"), same, "left_semi").select(*hits.columns))
    names = F.array(*(F.lit(rule.name) for rule in rules))
    return reduce(DataFrame.unionByName, parts).withColumn("rule", F.element_at(names, F.col("_rule") + 1)).drop("_rule")


def anchored_windows(
    df: DataFrame, window_seconds: float, null_ts: str = "keep", partitions: int | None = None
) -> DataFrame:
    """Add ``window_start`` and ``window_end`` of windows that open at their first row, per source.

    In arrival order, a row at or past the end of the current window opens the next one at its own time. Rows without a
    time are in no window and keep NULL bounds, unless ``null_ts`` says otherwise.
    """
    require(window_seconds > 0, "window_seconds must be positive")
    timed = with_event_time(df, null_ts)
    width = micros(window_seconds)
    narrow = _timed(timed).select(*ROW_ID, "t")
    schema = f"{_IDS}, window_start long"
    starts = chunked_fold(narrow, F.col("source"), ["seq"], AnchorFold(width), schema, partitions)
    joined = timed.join(starts, ROW_ID, "left")
    return joined.select(
        *df.columns,
        F.timestamp_micros("window_start").alias("window_start"),
        F.timestamp_micros(F.col("window_start") + width).alias("window_end"),
    )


def window_summaries(windowed: DataFrame) -> DataFrame:
    """Per source and anchored window: its number in the source, bounds, total and counts by level."""
    keys = ["source", "window_start", "window_end"]
    counts = windowed.groupBy(*keys, level_name().alias("_level")).agg(F.count("*").alias("_n"))
    summed = counts.groupBy(*keys).agg(
        F.sum("_n").alias("total"), counts_map(F.col("_level"), F.col("_n")).alias("levels")
    )
    # A window without bounds comes first; windows of a source start at different times.
    placed = summed.withColumn("_start", F.coalesce(F.unix_micros("window_start"), F.lit(-(1 << 62))))
    return with_row_number(placed, "window_id", order="_start").drop("_start")


def _digests(df: DataFrame) -> DataFrame:
    """Row ids and message digests, written once: the branches below would each read all messages again."""
    return materialize(df.select(*ROW_ID, message_digest().alias("digest")), "digests")


def _few_messages(digests: DataFrame, window_size: int) -> DataFrame:
    """Sources with at most ``window_size`` distinct messages: for them nothing is ever forgotten."""
    distinct = digests.select("source", "digest").distinct()
    sizes = distinct.groupBy("source").agg(F.count("*").alias("_messages"))
    # Written, so that a join with it shuffles both sides and a large source is split.
    return materialize(sizes.where(F.col("_messages") <= window_size).select("source"), "few-messages")


def dedup_logs(
    df: DataFrame, window_size: int = 256, max_repeats: int = 1, partitions: int | None = None
) -> DataFrame:
    """Pass the first ``max_repeats`` rows of each message, remembering ``window_size`` messages per source.

    Sources with few messages need no memory limit: there rows are numbered by message. Only the others are folded.
    """
    require(window_size >= 1, "window_size must be >= 1")
    require(max_repeats >= 1, "max_repeats must be >= 1")
    digests = _digests(df)
    few = _few_messages(digests, window_size)
    ranked = with_row_number(digests, "_nth", ["source", "digest"]).where(F.col("_nth") <= max_repeats)
    native = ranked.join(few, "source", "left_semi").select(*ROW_ID)
    folded = chunked_fold(
        digests.join(few, "source", "left_anti"),
        F.col("source"),
        ["seq"],
        DedupFold(window_size, max_repeats),
        f"{_IDS}, occurrence long",
        partitions,
    )
    return _keep(df, native.unionByName(folded.select(*ROW_ID)))


def suppressed_logs(
    df: DataFrame, window_size: int = 256, max_repeats: int = 1, partitions: int | None = None
) -> DataFrame:
    """The rows :func:`dedup_logs` holds back, each with the ``occurrence`` number of its message."""
    require(window_size >= 1, "window_size must be >= 1")
    require(max_repeats >= 1, "max_repeats must be >= 1")
    digests = _digests(df)
    few = _few_messages(digests, window_size)
    numbered = with_row_number(digests, "occurrence", ["source", "digest"])
    repeats = numbered.where(F.col("occurrence") > max_repeats)
    native = repeats.join(few, "source", "left_semi").select(*ROW_ID, "occurrence")
    folded = chunked_fold(
        digests.join(few, "source", "left_anti"),
        F.col("source"),
        ["seq"],
        DedupFold(window_size, max_repeats, report=True),
        f"{_IDS}, occurrence long",
        partitions,
    )
    return df.join(native.unionByName(folded), ROW_ID).select(*df.columns, "occurrence")


def sequence_logs(df: DataFrame, buffer_size: int = 50, partitions: int | None = None) -> DataFrame:
    """Reorder by timestamp text through a buffer of ``buffer_size`` rows; adds ``position`` in its source.

    Rows displaced by more than the buffer stay out of order, as they would in a live feed. For a complete
    sort use :func:`logloom.operators.ordered.sort_logs`.
    """
    require(buffer_size >= 1, "buffer_size must be >= 1")
    narrow = df.select(*ROW_ID, F.coalesce("timestamp", F.lit("")).alias("sort_key"))
    decided = chunked_fold(
        narrow, F.col("source"), ["seq"], ReorderFold(buffer_size), f"{_IDS}, released_by long", partitions
    )
    # Read by several branches below: write it, so that the fold runs once.
    released = materialize(decided, "released")
    pushed = with_row_number(
        released.where(F.col("released_by").isNotNull()), "position", order="released_by"
    ).select(*ROW_ID, "position")
    # At most buffer_size rows per source are left for the end.
    rest = released.where(F.col("released_by").isNull()).join(narrow, ROW_ID)
    last = Window.partitionBy("source").orderBy("sort_key", "seq")
    offsets = pushed.groupBy("source").agg(F.count("*").alias("_pushed"))
    drained = (
        rest.withColumn("_nth", F.row_number().over(last))
        .join(offsets, "source", "left")
        .select(*ROW_ID, (F.coalesce("_pushed", F.lit(0)) + F.col("_nth")).cast("long").alias("position"))
    )
    return df.join(pushed.unionByName(drained), ROW_ID).select(*df.columns, "position")
