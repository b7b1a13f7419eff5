"""Tables of other shapes as log rows. Absent values become typed NULLs, so every frame has the full schema."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.maps import empty_map
from logloom.operators.ordered import with_rank
from logloom.schema import LOG_COLUMNS, LOG_SCHEMA

TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def as_logs(df: DataFrame, **columns: Column) -> DataFrame:
    """Select the given expressions as log columns; ``extra`` starts as ``structured``."""
    columns.setdefault("structured", empty_map())
    columns.setdefault("extra", columns["structured"])
    columns.setdefault("is_json", F.lit(False))
    columns.setdefault("raw", columns["message"])
    return df.select(
        *[columns.get(n, F.lit(None)).cast(LOG_SCHEMA[n].dataType).alias(n) for n in LOG_COLUMNS]
    )


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def event_logs(spark: SparkSession, directory: str) -> DataFrame:
    return event_logs_of(_table(spark, directory, "events"))


def event_logs_of(events: DataFrame) -> DataFrame:
    """``events``, batch or stream: eight sources, one service per user, the event type as level."""
    props = F.from_json("props", "map<string,string>")
    service = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    fixed = F.create_map(F.lit("level"), F.col("event_type"), F.lit("service"), service)
    return as_logs(
        events,
        source=F.concat(F.lit("c"), (F.col("user_id") % 8).cast("string")),
        seq=F.col("event_id"),
        timestamp=F.date_format("ts", TIMESTAMP_FORMAT),
        ts=F.col("ts"),
        level=F.col("event_type"),
        service=service,
        message=F.concat(F.col("event_type"), F.lit(" value "), F.col("value").cast("string")),
        is_json=F.lit(True),
        structured=F.map_concat(fixed, props),
    )


def dense_times(logs: DataFrame) -> DataFrame:
    """Event times 5,000 times as close together, so that a source has several rows in a second."""
    return logs.withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 5000)))


def event_lines(spark: SparkSession, directory: str) -> DataFrame:
    """``events`` rendered as raw lines: JSON bodies, except that errors are plain text."""
    body = F.to_json(
        F.struct(
            F.col("event_type").alias("level"),
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("service"),
            F.concat(F.col("event_type"), F.lit(" value "), F.col("value").cast("string")).alias("msg"),
            F.get_json_object("props", "$.k").alias("k"),
        )
    )
    plain = F.concat(F.lit("ERROR value "), F.col("value").cast("string"))
    stamp = F.date_format("ts", TIMESTAMP_FORMAT)
    return _table(spark, directory, "events").select(
        F.concat(F.lit("c"), (F.col("user_id") % 8).cast("string")).alias("source"),
        F.col("event_id").alias("seq"),
        F.concat(stamp, F.lit(" "), F.when(F.col("event_type") == "error", plain).otherwise(body)).alias("raw"),
    )


def document_logs(spark: SparkSession, directory: str) -> DataFrame:
    """``documents``: whole texts as messages, without times or levels."""
    return as_logs(
        _table(spark, directory, "documents"),
        source=F.col("source"),
        seq=F.col("doc_id"),
        service=F.col("lang"),
        message=F.col("text"),
    )


def conversation_logs(spark: SparkSession, directory: str) -> DataFrame:
    """``conversations``: one trace per conversation, the role as level."""
    trace = F.create_map(F.lit("trace_id"), F.col("conv_id").cast("string"))
    return as_logs(
        _table(spark, directory, "conversations"),
        source=F.concat(F.lit("conv"), (F.col("conv_id") % 4).cast("string")),
        seq=F.shiftleft("conv_id", 32) + F.col("turn"),
        level=F.col("role"),
        message=F.col("text"),
        extra=trace,
    )


def page_logs(spark: SparkSession, directory: str) -> DataFrame:
    """``pages``: whole pages as messages."""
    return as_logs(
        _table(spark, directory, "pages"),
        source=F.lit("pages"),
        seq=F.col("page_id"),
        service=F.col("url"),
        message=F.col("html"),
    )


_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _line_seq(lines: DataFrame) -> tuple[DataFrame, Column]:
    """The rows and the column that numbers them: the keys' bits side by side, in the order of the keys.

    Keys too large for that (orders from 2^20) would overflow: then all rows are numbered by their place in that order.
    """
    order, number, part, supplier = keys = [F.col(name) for name in _LINE_KEYS]
    line = F.try_add(F.try_multiply(order, F.lit(8)), number)
    place = F.try_add(F.try_multiply(part, F.lit(1 << 16)), supplier)
    seq = F.try_add(F.try_multiply(line, F.lit(1 << 40)), place)
    named = reduce(Column.__and__, (key.isNotNull() for key in keys))
    if lines.where(named & seq.isNull()).isEmpty():
        return lines, seq
    rest = ["l_shipdate", "l_returnflag", "l_linestatus"]
    ranked = with_rank(lines.select(*_LINE_KEYS, *rest).orderBy(*_LINE_KEYS, *rest), "_rank")
    return ranked, F.when(named, F.col("_rank"))


def lineitem_logs(spark: SparkSession, directory: str, numbered: bool = True) -> DataFrame:
    """``lineitem``: shipments as log rows, the return flag as level and the line status as service.

    Order and line number repeat in the table; with part and supplier they name a row. ``numbered=False`` leaves ``seq``
    NULL, for queries that do not read it.
    """
    lines = _table(spark, directory, "lineitem")
    lines, seq = _line_seq(lines) if numbered else (lines, F.lit(None))
    return as_logs(
        lines,
        source=F.concat(F.lit("supplier-"), (F.col("l_suppkey") % 16).cast("string")),
        seq=seq,
        timestamp=F.date_format("l_shipdate", TIMESTAMP_FORMAT),
        ts=F.col("l_shipdate"),
        level=F.col("l_returnflag"),
        service=F.col("l_linestatus"),
        message=F.concat(F.lit("part "), F.col("l_partkey").cast("string")),
    )


def order_logs(spark: SparkSession, directory: str) -> DataFrame:
    """``orders``: the priority as level and message."""
    return as_logs(
        _table(spark, directory, "orders"),
        source=F.concat(F.lit("status-"), F.col("o_orderstatus")),
        seq=F.col("o_orderkey"),
        timestamp=F.date_format("o_orderdate", TIMESTAMP_FORMAT),
        ts=F.col("o_orderdate"),
        level=F.col("o_orderpriority"),
        message=F.concat(F.lit("priority "), F.col("o_orderpriority")),
    )
