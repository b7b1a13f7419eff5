"""Operators that depend on arrival order and need no running state: numbering, tail, sampling.

A source may hold a large part of all rows, so no window here spans a whole source. Row ids are range-partitioned by
source and order, so a source is spread over as many tasks as its rows need; each task notes the place of its rows, and
the first number of a source in a task is a running sum over the tasks that hold some of it.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.checkpoints import materialize
from logloom.operators.rules import require

# monotonically_increasing_id: the task above these bits, the place in the task in them.
_PLACE_BITS = 33


def _numbers(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """``by``, ``order``, ``_number`` (from 1) and ``_of`` (rows in all) of each row."""
    by = list(by)
    ranged = df.select(*by, order).repartitionByRange(*by, order).sortWithinPartitions(*by, order)
    # Written once: the ranges come from a sample, and both branches below must see the same ones.
    placed = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()), "places")
    task = F.shiftright("_place", _PLACE_BITS).alias("_task")
    stretches = placed.groupBy(*by, task).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    # At most one row per task.
    keys, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_task")
    starts = stretches.select(
        *by, "_task", (F.sum("_rows").over(before) - F.col("_rows") + 1 - F.col("_first")).alias("_shift"), F.sum("_rows").over(keys).alias("_of")
    )
    numbered = placed.withColumn("_task", task).join(starts, [*by, "_task"])
    return numbered.select(*by, order, (F.col("_place") + F.col("_shift")).alias("_number"), "_of")


def with_row_number(df: DataFrame, column: str, by: Sequence[str] = ("source",), order: str = "seq") -> DataFrame:
    """Add the 1-based position of each row within ``by``, in the order of the integer column ``order``.

    ``order`` must be unique within ``by``; neither may be NULL.
    """
    numbers = _numbers(df, by, order).select(*by, order, F.col("_number").alias(column))
    # Joined on the row's own id, which no source can skew.
    return df.join(numbers, [*by, order]).select(*df.columns, column)


def tail_logs(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each source. Apply before parsing and filtering."""
    require(n >= 0, "n must not be negative")
    last = _numbers(df, ["source"], "seq").where(F.col("_number") > F.col("_of") - n)
    return df.join(last.select("source", "seq"), ["source", "seq"], "left_semi").select(*df.columns)


def backfill_logs(df: DataFrame, backfill: int = 0) -> DataFrame:
    """What a tail keeps of the rows seen so far: the last ``backfill`` of each source, all of them for 0."""
    require(backfill >= 0, "backfill must not be negative")
    return tail_logs(df, backfill) if backfill else df


def sample_nth(df: DataFrame, n: int) -> DataFrame:
    """Rows number n, 2n, 3n, ... of each source."""
    require(n >= 1, "n must be >= 1")
    if n == 1:
        return df
    chosen = _numbers(df, ["source"], "seq").where(F.col("_number") % n == 0)
    return df.join(chosen.select("source", "seq"), ["source", "seq"], "left_semi").select(*df.columns)


_HASH_BITS = 32


def sample_fraction(seed: int) -> Column:
    """A number in [0, 1) fixed by the row's identity and ``seed``, so a lost task repeats the same choice."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "source", F.col("seq").cast("string")))
    head = F.conv(F.substring(digest, 1, _HASH_BITS // 4), 16, 10).cast("long")
    return head / F.lit(float(1 << _HASH_BITS))


def sample_rate(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Keep each row with probability ``rate``, independently and repeatably."""
    require(0.0 < rate <= 1.0, "rate must be in (0, 1]")
    return df if rate == 1.0 else df.where(sample_fraction(seed) < rate)


def sample_logs(df: DataFrame, every_nth: int = 1, rate: float = 1.0, seed: int = 0) -> DataFrame:
    """Every n-th row, then a random share of those."""
    require(every_nth >= 1, "every_nth must be >= 1")
    require(0.0 < rate <= 1.0, "rate must be in (0, 1]")
    return sample_rate(sample_nth(df, every_nth), rate, seed)


def sort_logs(df: DataFrame) -> DataFrame:
    """Each source in timestamp order, rows without a timestamp first, arrival order among equals.

    The order is global, over range-partitioned tasks, so a large source is spread over many of them.
    """
    return df.orderBy("source", F.coalesce("timestamp", F.lit("")), "seq")


def with_rank(ordered: DataFrame, column: str = "rank") -> DataFrame:
    """Add the 1-based position of each row of a globally ordered frame, without gathering it in one task."""
    placed = materialize(ordered.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    task = F.shiftright("_place", _PLACE_BITS)
    counts = placed.groupBy(task.alias("_task")).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    # One row per task.
    shift = F.sum("_rows").over(Window.orderBy("_task")) - F.col("_rows") + 1 - F.col("_first")
    shifts = counts.select("_task", shift.alias("_shift"))
    numbered = placed.withColumn("_task", task).join(shifts, "_task")
    return numbered.select(*ordered.columns, (F.col("_place") + F.col("_shift")).alias(column))
