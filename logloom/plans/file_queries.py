"""Queries that write log rows with a sink and read them back."""

import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from logloom.checkpoints import scratch_path
from logloom.functions.formats import EXPORT_COLUMNS
from logloom.operators import aggregate
from logloom.operators.filters import filter_logs
from logloom.operators.ordered import with_row_number
from logloom.operators.parse import parse_logs
from logloom.operators.rules import Route, SplitRule
from logloom.plans.registry import CONVERSATIONS, DOCUMENTS, EVENTS, LINES, PARSED, PLAIN_LINE, TEXT_LINE, query
from logloom.sinks import files as sinks
from logloom.sources.files import read_lines, read_logs, replay_logs
from logloom.sources.follow import follow_lines
from logloom.sources.tables import conversation_logs, document_logs, event_lines, event_logs

_LINE_SQL = "SELECT level, is_json, message, epoch_us(ts) AS us FROM logs"


def _written_lines(spark, sf, **options):
    path = scratch_path(spark, "lines")
    event_lines(spark, sf).select("raw").write.text(path, **options)
    return path


@query(f"WITH {PARSED} {_LINE_SQL} WHERE level = 'purchase'")
def replay_files(spark, sf):
    logs = read_logs(spark, _written_lines(spark, sf), source="feed")
    return filter_logs(logs, level="purchase").select("level", "is_json", "message", F.unix_micros("ts").alias("us"))


@query(f"WITH {PARSED} {_LINE_SQL} WHERE level IS NULL")
def replay_gzip(spark, sf):
    logs = replay_logs(spark, _written_lines(spark, sf, compression="gzip"), F.col("level").isNull())
    return logs.select("level", "is_json", "message", F.unix_micros("ts").alias("us"))


@query(f"WITH {LINES}, feed AS (SELECT raw, row_number() OVER (ORDER BY seq) AS place FROM lines) SELECT * FROM feed")
def replay_sequence(spark, sf):
    """Every line has its own place in the feed, in the order of its files and lines."""
    path = scratch_path(spark, "lines")
    event_lines(spark, sf).orderBy("seq").select("raw").write.text(path)
    return with_row_number(read_lines(spark, path, source="feed"), "place").select("raw", "place")


def _rotated(spark, sf):
    """A folder with app.log and its rotated forerunners, the older half of them zipped: as many as Spark's tasks write."""
    folder, lines = scratch_path(spark, "rotated"), event_lines(spark, sf)
    middle = lines.agg(F.max("seq")).first()[0] // 2
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = files.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = []
    for part, older in ((f"{folder}/older", True), (f"{folder}/newer", False)):
        rows = lines.where((F.col("seq") <= middle) == older).orderBy("seq")
        rows.select("raw").write.text(part, compression="gzip" if older else "none")
        found = [s.getPath() for s in store.listStatus(files.Path(part))]
        written += sorted((f for f in found if f.getName().startswith("part-")), key=lambda f: f.getName())
    store.mkdirs(files.Path(f"{folder}/logs"))
    for age, file in enumerate(reversed(written)):
        target = "app.log" + (f".{age}" if age else "") + (".gz" if file.getName().endswith(".gz") else "")
        store.rename(file, files.Path(f"{folder}/logs/{target}"))
    return f"{folder}/logs"


@query(f"WITH {LINES} SELECT 'app' AS source, raw, row_number() OVER (ORDER BY seq) AS place FROM lines")
def replay_rotated(spark, sf):
    """Rotated files, plain and zipped, come oldest first."""
    lines = read_lines(spark, _rotated(spark, sf))
    return with_row_number(lines, "place").select("source", "raw", "place")


@query(f"WITH {LINES} SELECT 'app' AS source, raw FROM lines ORDER BY seq DESC LIMIT 3000")
def tail_files(spark, sf):
    """The last lines of a source that is spread over several files."""
    return read_lines(spark, _rotated(spark, sf), tail=3000).select("source", "raw")


@query(f"""WITH {CONVERSATIONS} SELECT level, message, row_number() OVER (ORDER BY source, seq) AS place FROM logs""")
def export_json_array(spark, sf):
    """One array over all part files, put together again."""
    path = scratch_path(spark, "array")
    sinks.write_json_array(conversation_logs(spark, sf), path)
    lines = read_lines(spark, path, source="array")
    item = F.from_json(F.regexp_replace(F.regexp_replace("raw", r"^\[", ""), r"[,\]]$", ""), "level string, message string")
    return with_row_number(lines.withColumn("item", item), "place").select("item.*", "place")


@query(f"WITH {DOCUMENTS} SELECT NULL::VARCHAR AS timestamp, NULL::VARCHAR AS level, message, message AS raw FROM logs")
def export_json_files(spark, sf):
    path = scratch_path(spark, "json")
    sinks.write_logs(document_logs(spark, sf), path, "json")
    return spark.read.schema(", ".join(f"{c} string" for c in EXPORT_COLUMNS)).json(path)


@query(f"""WITH {CONVERSATIONS} SELECT '' AS timestamp, level, regexp_replace(message, '\\r\\n?', chr(10), 'g') AS message
FROM logs""")
def export_csv_files(spark, sf):
    """Texts with quotes, commas and line ends. Readers of CSV may turn every line end into LF."""
    path = scratch_path(spark, "csv")
    sinks.write_logs(conversation_logs(spark, sf), path, "csv")
    back = spark.read.csv(
        path, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    message = F.regexp_replace("message", r"\r\n?", "\n").alias("message")
    return back.select(F.coalesce("timestamp", F.lit("")).alias("timestamp"), "level", message)


@query(f"WITH {PARSED} SELECT {TEXT_LINE} AS value FROM logs")
def export_text_files(spark, sf):
    path = scratch_path(spark, "text")
    sinks.write_logs(parse_logs(event_lines(spark, sf)), path, "text")
    return spark.read.text(path)


@query(f"WITH {PARSED} SELECT {PLAIN_LINE} AS value FROM logs")
def export_plain_files(spark, sf):
    path = scratch_path(spark, "plain")
    sinks.write_logs(parse_logs(event_lines(spark, sf)), path, "plain")
    return spark.read.text(path)


@query(f"""WITH {EVENTS} SELECT CASE WHEN level = 'error' THEN 'errors' ELSE 'rest' END AS bucket, count(*) AS n,
CAST(sum(seq) AS BIGINT) AS seqs FROM logs GROUP BY ALL""")
def split_files(spark, sf):
    path = scratch_path(spark, "split")
    sinks.write_split(event_logs(spark, sf), [SplitRule("errors", "level = 'error'")], path, "rest")
    return spark.read.parquet(path).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(f"""WITH {EVENTS} SELECT 'buy' AS route, source, seq FROM logs WHERE level = 'purchase'
UNION ALL SELECT 'all', source, seq FROM logs""")
def route_files(spark, sf):
    path = scratch_path(spark, "routes")
    sinks.write_routes(event_logs(spark, sf), [Route("buy", "level = 'purchase'"), Route("all", "true")], path)
    return spark.read.parquet(path).select("route", "source", "seq")


@query(f"""WITH {EVENTS} SELECT 'a' AS sink, source, seq, message FROM logs UNION ALL SELECT 'b', source, seq, message FROM logs""")
def tee_files(spark, sf):
    paths = {name: scratch_path(spark, f"tee-{name}") for name in "ab"}
    rows = event_logs(spark, sf).select("source", "seq", "message")
    sinks.tee_logs(rows, {"a": lambda df: df.write.parquet(paths["a"]), "b": lambda df: df.write.json(paths["b"])})
    read = [spark.read.parquet(paths["a"]), spark.read.schema(rows.schema).json(paths["b"])]
    return read[0].withColumn("sink", F.lit("a")).unionByName(read[1].withColumn("sink", F.lit("b")))


@query(f"""WITH {CONVERSATIONS} SELECT source, trace_id AS key, count(*) AS count FROM logs GROUP BY ALL
HAVING count(*) >= 2""")
def group_report(spark, sf):
    path = scratch_path(spark, "groups")
    sinks.write_group_report(aggregate.correlation_groups(conversation_logs(spark, sf), min_group_size=2), path)
    return spark.read.schema("source string, key string, count long").json(path)


def _local(folder: str) -> str:
    """A folder of the local (or mounted, shared) file system, also when named by a ``file:`` URI."""
    parsed = urlparse(folder)
    return parsed.path if parsed.scheme == "file" else folder


def _write_growing(lines, folder: str, sizes: dict[str, int] | None) -> dict[str, int]:
    """Write each ``name``'s lines, in ``seq`` order, to ``<folder>/<name>.log``: a task per group of names.

    With ``sizes`` the lines are appended after cutting each file back to its size, so a task run twice appends once.
    Returns the size of every file written.
    """
    local = _local(folder)

    def write(batches):
        import pyarrow as pa

        handle, current, written = None, None, {}
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("raw").to_pylist()):
                if name != current:
                    if handle:
                        written[current] = handle.tell()
                        handle.close()
                    current, path = name, os.path.join(local, f"{name}.log")
                    if sizes is None or not os.path.exists(path):
                        handle = open(path, "wb")
                    else:
                        handle = open(path, "r+b")
                        handle.truncate(sizes.get(name, 0))
                        handle.seek(0, os.SEEK_END)
                handle.write(raw.encode() + b"\n")
        if handle:
            written[current] = handle.tell()
            handle.close()
        yield pa.RecordBatch.from_pydict({"name": list(written), "size": list(written.values())}, schema=pa.schema([("name", pa.string()), ("size", pa.int64())]))

    ordered = lines.repartition("name").sortWithinPartitions("name", "seq")
    return {r["name"]: r["size"] for r in ordered.select("name", "seq", "raw").mapInArrow(write, "name string, size long").collect()}


@query(f"""WITH {LINES}, named AS (SELECT source || '-' || (seq % 4) AS name, seq, raw FROM lines)
SELECT name, raw, row_number() OVER (PARTITION BY name ORDER BY seq) AS place FROM named""")
def follow_growing(spark, sf):
    """Files that grow between two triggers of a stream that follows them: every line arrives once, in file order.

    Lines are written to a file per source and remainder of ``seq`` by 4, the older half first; the stream takes them,
    the newer half is appended to the same files, and the stream takes the rest. Lines are numbered in each file by their
    byte offsets, which the stream hands out.
    """
    folder, out, state = (scratch_path(spark, name) for name in ("growing", "followed", "followed-state"))
    lines = event_lines(spark, sf).select(F.concat_ws("-", "source", (F.col("seq") % 4).cast("string")).alias("name"), "seq", "raw")
    middle = lines.agg(F.max("seq")).first()[0] // 2
    os.makedirs(_local(folder), exist_ok=True)
    sizes = _write_growing(lines.where(F.col("seq") <= middle), folder, None)
    stream = follow_lines(spark, folder).writeStream.format("parquet").option("checkpointLocation", state).start(out)
    try:
        stream.processAllAvailable()
        _write_growing(lines.where(F.col("seq") > middle), folder, sizes)
        stream.processAllAvailable()
    finally:
        stream.stop()
    got = spark.read.parquet(out).select(F.regexp_extract("file", r"([^/]+)\.log$", 1).alias("name"), "seq", "raw")
    return with_row_number(got, "place", by=("name",), order="seq").select("name", "raw", "place")
