"""Log files as tables of raw lines: plain text or gzip, single files, globs or directories, batch or stream."""

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import matches
from logloom.operators.ordered import tail_logs
from logloom.operators.parse import parse_logs
from logloom.workers import ship_package

# Fixed list: the suffixes that are not part of a container's name. A rotation number may follow.
FILE_SUFFIX = r"(\.(log|txt|json|jsonl))?(\.[0-9]+)?(\.gz)?$"
# Files of one source are told apart in seq by their rank, above the bits for the place in the file.
_FILE_SHIFT = 44
_ROW_BITS = (1 << 33) - 1
# In streams a file's numbers start at a place drawn from its path and time, below this.
_STREAM_BASE = (1 << 62) - 1


def source_of_file(name: Column) -> Column:
    """The container a file belongs to: its name without log, rotation and gzip suffixes."""
    return F.regexp_replace(name, FILE_SUFFIX, "")


def _place() -> Column:
    """A number that grows along a file.

    The offset of a split, plus the row's number in its task. Spark packs splits of full size alone, so that
    number starts at 0 in all but the last split of a file, and no line is shorter than one byte.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    return F.col("_metadata.file_block_start") + row


def _lines(files: DataFrame, source: str | None, *columns: Column) -> DataFrame:
    name = F.lit(source) if source is not None else source_of_file(F.col("_metadata.file_name"))
    return files.select(name.alias("source"), F.make_valid_utf8("value").alias("raw"), *columns)


def _number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same place as :func:`_place`; streams have no row number function, so the task counts its lines."""
    row = 0
    for batch in batches:
        place = batch.column("seq").to_numpy(zero_copy_only=False) + np.arange(row, row + batch.num_rows)
        row += batch.num_rows
        yield batch.set_column(batch.schema.get_field_index("seq"), "seq", pa.array(place, pa.int64()))


def arrival_key(path: str) -> tuple[bool, int, str]:
    """Sorts the files of a source by age: rotated ones from the highest number down, then the others by path."""
    rotation = re.search(r"\.([0-9]+)(\.gz)?$", path)
    return rotation is None, -int(rotation[1]) if rotation else 0, path


def _rank_files(lines: DataFrame, source: str | None) -> DataFrame:
    """Put the files of a source one after the other in ``seq``, oldest first.

    The listing is the one Spark's driver already holds for the scan: one row per file.
    """
    ranks: list[tuple[int, str]] = []
    sizes: dict[str, int] = {}
    for path in sorted(lines.inputFiles(), key=arrival_key):
        owner = source if source is not None else re.sub(FILE_SUFFIX, "", path.rsplit("/", 1)[-1])
        ranks.append((sizes.get(owner, 0), path))
        sizes[owner] = sizes.get(owner, 0) + 1
    if not any(rank for rank, _ in ranks):
        return lines.select("source", "seq", "raw")
    if any(rank >= 1 << (63 - _FILE_SHIFT) for rank, _ in ranks):
        raise ValueError(f"a source has more than {1 << (63 - _FILE_SHIFT)} files")
    # One row per file, which the driver holds already; Spark cannot size a frame of Python rows, so say it is small,
    # or it would move the lines instead.
    listing = F.broadcast(lines.sparkSession.createDataFrame(ranks, "_rank long, _path string"))
    ranked = lines.join(listing, F.col("_file") == F.col("_path"))
    place = F.when(F.col("seq") < 1 << _FILE_SHIFT, F.col("seq")).otherwise(F.raise_error(F.lit(f"a file is longer than 2^{_FILE_SHIFT} bytes")))
    seq = F.shiftleft("_rank", _FILE_SHIFT) + place
    return ranked.select("source", seq.alias("seq"), "raw")


def read_lines(
    spark: SparkSession, path: str | Sequence[str], source: str | None = None, tail: int | None = None
) -> DataFrame:
    """Raw lines as ``(source, seq, raw)``. Bytes that are not UTF-8 are replaced. A missing path is an error.

    Every file is its own source, named after it, unless ``source`` names one for all. Rotated files of a source come
    oldest first: ``app.log.10``, ``app.log.2.gz``, ``app.log.1``, ``app.log``; files without a number by path. ``tail``
    keeps the last lines of each source.
    """
    if tail is not None:
        return _tail_lines(spark, path, source, tail)
    # Written as in the listing; _metadata.file_path spells local paths differently.
    file = F.input_file_name().alias("_file")
    return _rank_files(_lines(spark.read.text(path), source, _place().alias("seq"), file), source)


def _tail_lines(spark: SparkSession, path: str | Sequence[str], source: str | None, n: int) -> DataFrame:
    """The last ``n`` lines of each source, read from the ends of its files: each file gives at most its last ``n``
    lines (found by reading backwards; gzip files are read whole), and the last ``n`` of each source are kept of those.
    ``seq`` is the file's rank among those of its source, above the byte offset of the line."""
    from logloom.sources import follow

    paths = [path] if isinstance(path, str) else list(path)
    files = sorted({f for p in paths for f in follow.listing(p)}, key=arrival_key)
    ranks, counts = [], {}
    for f in files:
        owner = source if source is not None else re.sub(FILE_SUFFIX, "", f.rsplit("/", 1)[-1])
        ranks.append((counts.get(owner, 0), f))
        counts[owner] = counts.get(owner, 0) + 1
    if any(rank >= 1 << (63 - _FILE_SHIFT) for rank, _ in ranks):
        raise ValueError(f"a source has more than {1 << (63 - _FILE_SHIFT)} files")
    last = None
    for p in paths:
        part = follow.tail_lines(spark, p, n)
        last = part if last is None else last.unionByName(part)
    # One row per file, held by the driver already.
    listing = F.broadcast(spark.createDataFrame(ranks, "_rank long, file string"))
    name = F.lit(source) if source is not None else F.col("source")
    offset = F.when(F.col("seq") < 1 << _FILE_SHIFT, F.col("seq")).otherwise(F.raise_error(F.lit(f"a file is longer than 2^{_FILE_SHIFT} bytes")))
    ranked = last.join(listing, "file").select(name.alias("source"), (F.shiftleft("_rank", _FILE_SHIFT) + offset).alias("seq"), "raw")
    return tail_logs(ranked, n)


def read_logs(
    spark: SparkSession,
    path: str | Sequence[str],
    source: str | None = None,
    tail: int | None = None,
    text_level: bool = False,
) -> DataFrame:
    """Parsed log rows of saved files."""
    return parse_logs(read_lines(spark, path, source, tail), text_level)


def replay_logs(spark: SparkSession, path: str | Sequence[str], predicate: Column | None = None) -> DataFrame:
    """Parsed log rows of saved files for which ``predicate`` holds."""
    logs = read_logs(spark, path)
    return logs if predicate is None else logs.where(matches(predicate))


def stream_lines(
    spark: SparkSession, path: str, source: str | None = None, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Raw lines of files as they appear in a directory.

    ``seq`` grows along a file. A stream cannot number its files, so each starts at a hash of its path and modification
    time in 2^62 places: two files of a gigabyte share an id with a probability of 2^-31.
    """
    ship_package(spark)
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    file = F.xxhash64("_metadata.file_path", "_metadata.file_modification_time").bitwiseAND(F.lit(_STREAM_BASE))
    lines = _lines(reader.text(path), source, (file + F.col("_metadata.file_block_start")).alias("seq"))
    return lines.mapInArrow(_number_lines, lines.schema)


def stream_logs(
    spark: SparkSession,
    path: str,
    source: str | None = None,
    max_files_per_trigger: int | None = None,
    text_level: bool = False,
) -> DataFrame:
    """Parsed log rows of files as they appear in a directory."""
    return parse_logs(stream_lines(spark, path, source, max_files_per_trigger), text_level)
