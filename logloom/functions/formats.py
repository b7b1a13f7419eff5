"""One-line renderings of a log row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import or_default, pad_right

EXPORT_COLUMNS = ["timestamp", "level", "message", "raw"]
_LEVEL_WIDTH = 7


def text_line() -> Column:
    """``[timestamp] message``, or the message alone when there is no timestamp."""
    stamp = F.nullif(F.col("timestamp"), F.lit(""))
    prefix = F.coalesce(F.concat(F.lit("["), stamp, F.lit("] ")), F.lit(""))
    return F.concat(prefix, F.coalesce("message", F.lit("")))


def plain_line() -> Column:
    """``timestamp  LEVEL    message`` with the level padded; a missing level reads UNKNOWN."""
    level = pad_right(F.upper(or_default(F.col("level"), "UNKNOWN")), _LEVEL_WIDTH)
    gap = F.lit("  ")
    return F.concat(F.coalesce("timestamp", F.lit("")), gap, level, gap, F.coalesce("message", F.lit("")))


def json_line() -> Column:
    """The exported columns as one JSON object, NULLs kept."""
    return F.to_json(F.struct(*EXPORT_COLUMNS), {"ignoreNullFields": "false"})


def csv_fields() -> list[Column]:
    """The exported columns with NULL as the empty string."""
    return [F.coalesce(c, F.lit("")).alias(c) for c in EXPORT_COLUMNS]
