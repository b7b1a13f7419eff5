"""Filters over log rows."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.fuzzy import may_reach, partial_score
from logloom.functions.text import contains_ci, equals_ci, matches

DEFAULT_FUZZY_THRESHOLD = 60


def exact_filter(df: DataFrame, keyword: str) -> DataFrame:
    """Rows whose message holds ``keyword``, in any case."""
    return df.where(contains_ci(F.col("message"), keyword))


def fuzzy_filter(df: DataFrame, keyword: str, threshold: int = DEFAULT_FUZZY_THRESHOLD) -> DataFrame:
    """Rows whose message matches ``keyword`` with a partial score of at least ``threshold``.

    A native bound leaves out, before any Python runs, the messages that cannot reach the threshold."""
    message = F.col("message")
    return df.where(may_reach(message, keyword, threshold) & (partial_score(message, keyword) >= threshold))


def structured_level() -> Column:
    """The level in the JSON payload: ``level`` if that key exists, even as null, else ``severity``."""
    has_level = F.map_contains_key("structured", F.lit("level"))
    return F.when(has_level, F.element_at("structured", F.lit("level"))).otherwise(
        F.element_at("structured", F.lit("severity"))
    )


def level_filter(df: DataFrame, level: str) -> DataFrame:
    """JSON rows at ``level``; plain rows never pass."""
    return df.where(F.col("is_json") & equals_ci(structured_level(), level))


def level_equals(df: DataFrame, level: str) -> DataFrame:
    """Rows whose level column is ``level``, JSON or not."""
    return df.where(equals_ci(F.col("level"), level))


def since_filter(df: DataFrame, since: datetime | str | Column) -> DataFrame:
    """Rows at or after an instant; rows without a time do not pass."""
    instant = since if isinstance(since, Column) else F.lit(since).cast("timestamp")
    return df.where(F.col("ts") >= instant)


def predicate_filter(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which any Spark predicate (column or SQL text) holds."""
    return df.where(matches(F.expr(predicate) if isinstance(predicate, str) else predicate))


def filter_logs(
    df: DataFrame,
    keyword: str | None = None,
    fuzzy: bool = False,
    level: str | None = None,
    threshold: int = DEFAULT_FUZZY_THRESHOLD,
    since: datetime | str | Column | None = None,
) -> DataFrame:
    """All given filters together; the cheap native ones run before the fuzzy score."""
    if since is not None:
        df = since_filter(df, since)
    if level:
        df = level_filter(df, level)
    if keyword:
        df = fuzzy_filter(df, keyword, threshold) if fuzzy else exact_filter(df, keyword)
    return df
