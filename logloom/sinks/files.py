"""Export of log rows, and writers that fan rows out to several places."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from logloom.checkpoints import materialize
from logloom.functions.formats import EXPORT_COLUMNS, json_line, plain_line, text_line
from logloom.operators.ordered import with_rank
from logloom.operators.rules import Route, RuleError, SplitRule, require
from logloom.operators.tag import explode_routes, route_logs, split_logs

FORMATS = ("json", "csv", "text", "plain")


class SinkError(RuntimeError):
    """One or more sinks failed."""


def write_logs(df: DataFrame, path: str, fmt: str = "text", mode: str = "errorifexists") -> None:
    """Write log rows as JSON lines, CSV with a header, ``[timestamp] message`` text, or plain level lines.

    Files are written by all tasks in parallel, in the order of ``df``'s partitions.
    """
    if fmt == "json":
        df.select(*EXPORT_COLUMNS).write.mode(mode).json(path, ignoreNullFields=False)
    elif fmt == "csv":
        df.select(*EXPORT_COLUMNS).write.mode(mode).csv(
            path,
            header=True,
            escape='"',
            nullValue="",
            emptyValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    elif fmt in ("text", "plain"):
        line = text_line() if fmt == "text" else plain_line()
        df.select(line.alias("value")).write.mode(mode).text(path)
    else:
        raise RuleError(f"unsupported format {fmt!r}; use one of {FORMATS}")


def write_json_array(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The export columns as one JSON array in ``(source, seq)`` order: the part files, one after the other.

    Tasks write the brackets and commas, too, so an array may be of any size; an empty frame gives ``[]``.
    """
    ranked = materialize(with_rank(df.select("source", "seq", json_line().alias("line")).orderBy("source", "seq"), "nth"), "json-array")
    last = ranked.agg(F.coalesce(F.max("nth"), F.lit(0)).alias("last")).first()["last"]
    line = F.concat(F.when(F.col("nth") == 1, "[").otherwise(""), "line", F.when(F.col("nth") == last, "]").otherwise(","))
    lines = ranked.select("nth", line.alias("value")) if last else df.sparkSession.range(1).select(F.lit(1).alias("nth"), F.lit("[]").alias("value"))
    lines.orderBy("nth").select("value").write.mode(mode).text(path)


def write_group_report(groups: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Correlation groups as JSON lines."""
    groups.write.mode(mode).json(path, ignoreNullFields=False)


def write_split(
    df: DataFrame, rules: Sequence[SplitRule], path: str, catch_all: str = "default", mode: str = "errorifexists"
) -> None:
    """One directory per bucket that has rows."""
    split_logs(df, rules, catch_all).write.mode(mode).partitionBy("bucket").parquet(path)


def write_routes(df: DataFrame, routes: Sequence[Route], path: str, mode: str = "errorifexists") -> None:
    """One directory per route that has rows; a row is written once for every route it takes."""
    explode_routes(df, routes).write.mode(mode).partitionBy("route").parquet(path)


def _with_persisted(df: DataFrame, use: Callable[[DataFrame], None]) -> None:
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        use(kept)
    finally:
        kept.unpersist()


def tee_logs(df: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], fail_fast: bool = True) -> None:
    """Hand all rows to every sink.

    With ``fail_fast`` the first failure stops the run; otherwise every sink is called and one error names
    all that failed. The unit of failure is the whole frame (a micro-batch when streaming).
    """
    require(bool(sinks), "at least one sink is needed")
    for name, sink in sinks.items():
        require(bool(name.strip()), "sink name must not be empty")
        require(callable(sink), f"sink {name!r} must be callable")

    def run(kept: DataFrame) -> None:
        errors = []
        for name, sink in sinks.items():
            try:
                sink(kept)
            except Exception as exc:
                if fail_fast:
                    raise SinkError(f"sink {name!r} failed: {exc}") from exc
                errors.append(f"{name!r}: {exc}")
        if errors:
            raise SinkError("sinks failed: " + "; ".join(errors))

    _with_persisted(df, run)


def dispatch_routes(df: DataFrame, routes: Sequence[Route]) -> None:
    """Hand each route's rows to its sink."""

    def run(routed: DataFrame) -> None:
        for route in routes:
            if route.sink is not None:
                route.sink(routed.where(F.array_contains("_routes", route.name)).drop("_routes"))

    _with_persisted(route_logs(df, routes, "_routes"), run)
