"""Web pages in seekable Zstandard bundles of WARC records.

A bundle is a row of independent zstd frames, each a whole number of records, and a seek table at the end in the public
seekable format (a skippable frame of compressed and decompressed sizes). The index maps record ids to (bundle, frame,
offset in the frame), so one record costs one frame.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page id is a response and the
others are revisits of it; rows that share that largest id are all responses.

Rows: null html is an empty payload, a null url an empty target; line ends in a url are percent-encoded. Null page ids
are written, and refer or are referred to only as far as an id is known. An empty table gives no bundle and no row. Extra
columns are not read.
"""

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.checkpoints import materialize
from logloom.llm import storage, texts
from logloom.workers import ship_package

# Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit, which has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _page(value: str | None) -> int | None:
    number = (value or "").strip("<>").removeprefix(_ID)
    return int(number) if number else None


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """(record, where the next one begins)."""
    body = data.index(b"\r\n\r\n", at) + 4
    fields = _fields(data[at : body - 4])
    end = body + int(fields["Content-Length"])
    payload_at = data.index(b"\r\n\r\n", body) + 4
    http = _fields(data[body : payload_at - 4])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = data[payload_at:end] if kind == "response" else None
    if payload is not None and (base32_sha1(payload) != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    row = {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(fields.get("WARC-Refers-To")),
        "payload": payload,
    }
    return row, end + 4


class BundleWriter:
    """Frames of about ``frame_bytes``; ``close`` gives the file's bytes with its seek table."""

    def __init__(self, frame_bytes: int):
        self.squeeze, self.frame_bytes = zstandard.ZstdCompressor(level=3), frame_bytes
        self.out, self.frame, self.sizes = bytearray(), bytearray(), []

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.frame and len(self.frame) + len(data) > self.frame_bytes:
            self._end_frame()
        at = len(self.sizes), len(self.frame)
        self.frame += data
        return at

    def _end_frame(self):
        packed = self.squeeze.compress(bytes(self.frame))
        self.sizes.append((len(packed), len(self.frame)))
        self.out += packed
        self.frame = bytearray()

    def close(self) -> bytes:
        if self.frame:
            self._end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE, len(table)) + table


class BundleReader:
    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * n)
        self.sizes = list(struct.iter_unpack("<II", file.read(8 * n)))
        self.offsets = [0]
        for packed, _ in self.sizes:
            self.offsets.append(self.offsets[-1] + packed)

    def frame(self, i: int) -> bytes:
        self.file.seek(self.offsets[i])
        return zstandard.decompress(self.file.read(self.sizes[i][0]), max_output_size=self.sizes[i][1])

    def record(self, frame: int, offset: int) -> dict:
        return parse_record(self.frame(frame), offset)[0]

    def records(self):
        for i in range(len(self.sizes)):
            data, at = self.frame(i), 0
            while at < len(data):
                row, at = parse_record(data, at)
                yield row


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id, key, refers_to`` of the pages whose payload another page has as a response."""
    sizes = F.octet_length("html")
    narrow = pages.select("page_id", "key").where(sizes >= min_bytes)
    # Written, so that both sides of the join are shuffled and a very common payload is split.
    classes = materialize(
        narrow.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n"),
        "warc-classes",
    )
    # Null ids are never equal to the largest one.
    others = narrow.join(classes, "key").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return others.distinct()


_INDEX = "path string, page_id long, frame int, offset long, length long"


def write_bundles(
    pages: DataFrame,
    directory: str,
    min_bytes: int = 0,
    frame_bytes: int = 1 << 20,
    bundle_bytes: int = 1 << 26,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row of (page_id, url, html); the index has one row per record.

    A task writes its rows to bundles of about ``bundle_bytes`` uncompressed bytes, holding one bundle at a time.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("key", F.sha2(F.col("html").cast("binary"), 256))
    marks = materialize(revisits(rows, min_bytes), "warc-revisits").select(F.col("page_id").alias("p"), F.col("key").alias("k"), "refers_to")
    marked = rows.join(marks, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches):
        part, number = TaskContext.get().partitionId(), 0
        bundle, size, index = BundleWriter(frame_bytes), 0, []

        def flush():
            path = f"{directory}/part-{part:06d}-{number:05d}.warc.zst"
            storage.write_file(path, bundle.close())
            page_ids, frames, offsets, lengths = zip(*index)
            return pa.RecordBatch.from_arrays(
                [pa.array([path] * len(index)), pa.array(page_ids, pa.int64()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["path", "page_id", "frame", "offset", "length"],
            )

        for batch in texts.slices(batches, "html"):
            for row in batch.to_pylist():
                data = record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], date)
                index.append((row["page_id"], *bundle.add(data), len(data)))
                size += len(data)
            if size >= bundle_bytes:
                yield flush()
                number, bundle, size, index = number + 1, BundleWriter(frame_bytes), 0, []
        if index:
            yield flush()

    return materialize(marked.mapInArrow(write, _INDEX), "warc-index")


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_bundles(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the bundles; digests of responses are checked. Bundles are spread over tasks; a task decodes
    one frame at a time."""
    ship_package(index.sparkSession)
    names = [field.split()[0] for field in _RECORD.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with storage.open_file(path) as file:
                    rows = []
                    for row in BundleReader(file).records():
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        if len(rows) >= (256 if with_payload else 4096):
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    return _bundles(index).mapInArrow(read, _RECORD + (", payload binary" if with_payload else ""))


def _bundles(index: DataFrame) -> DataFrame:
    """The bundle paths, dealt round-robin over as many tasks as there are bundles (at most four per shuffle
    partition). A repartition by number is neither dropped after ``distinct`` nor merged by adaptive execution."""
    files = index.select("path").distinct()
    return files.repartition(max(1, min(files.count(), 4 * texts.partitions(index.sparkSession))))


def fetch(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of some index rows, reading their frames only."""
    ship_package(index.sparkSession)
    names = [field.split()[0] for field in _RECORD.split(", ")] + ["payload"] * with_payload

    def read(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, frame_no, offset in frame[["path", "frame", "offset"]].itertuples(index=False):
                with storage.open_file(path) as file:
                    row = BundleReader(file).record(frame_no, offset)
                rows.append({n: row[n] for n in names})
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.select("path", "frame", "offset").mapInPandas(read, _RECORD + (", payload binary" if with_payload else ""))
