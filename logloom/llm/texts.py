"""What several operators need of whole texts: Arrow batches in bounded slices, words, distinct folds."""

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges whose texts have about ``max_bytes`` together; a longer single text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = size = 0
        for i, n in enumerate(sizes):
            if size and size + n > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def thirds(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 marks held-out rows."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def text_crc(value) -> int:
    return zlib.crc32(str(value).encode())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
