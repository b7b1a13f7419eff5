"""Token ids in wavelet matrices: one compressed, seekable file per shard.

A shard holds the ids of consecutive documents. Bit plane ``l`` has bit ``l`` (highest first) of every id in the order
that the planes above have sorted them into (zeros before ones, stably). Planes are cut into blocks of ``block_bits``
bits; each block is a zstd frame of its own, and the footer names its offset and the ones before it. So access, rank and
select read one block per plane, not the file.

File: blocks of all planes, document table, footer (zstd JSON), its length (8 bytes), magic.

Rows: documents come in ascending id order (null ids first; repeated ids by the hash of their texts). A null text is an
empty one: it has the end id only. An empty table gives no file and no row. Extra columns are not read.
"""

import json
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.checkpoints import materialize
from logloom.llm import storage, texts, tokens
from logloom.workers import ship_package

MAGIC = b"LLWAVEM1"


def build(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, block_bits: int = 1 << 16) -> bytes:
    """The file of one shard."""
    squeeze = zstandard.ZstdCompressor(level=1)
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    rest = ids.astype(np.uint16 if width <= 16 else np.uint32)
    body, planes = bytearray(), []
    for level in range(width - 1, -1, -1):
        ones = (rest & rest.dtype.type(1 << level)) != 0
        packed = np.packbits(ones)
        # Blocks are whole bytes.
        counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), block_bits // 8), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
        before = [0, *np.cumsum(counts).tolist()]
        zeros = len(ones) - before[-1]
        offsets, sorted_ = [], np.empty_like(rest)
        # A block at a time: it stays in the cache, and compress is twice as fast as indexing by a mask.
        for i, begin in enumerate(range(0, len(ones), block_bits)):
            offsets.append(len(body))
            body += squeeze.compress(packed[begin // 8 : (begin + block_bits) // 8].data)
            some, bits = rest[begin : begin + block_bits], ones[begin : begin + block_bits]
            sorted_[begin - before[i] : begin + len(some) - before[i + 1]] = np.compress(~bits, some)
            sorted_[zeros + before[i] : zeros + before[i + 1]] = np.compress(bits, some)
        planes.append({"zeros": zeros, "offsets": [*offsets, len(body)], "ones": before})
        rest = sorted_
    table = len(body)
    missing = np.array([d is None for d in doc_ids], bool)
    known = np.array([0 if d is None else d for d in doc_ids], np.int64)
    body += squeeze.compress(np.packbits(missing).tobytes() + known.tobytes() + np.asarray(lengths, np.int64).tobytes())
    footer = {"n": len(ids), "docs": len(doc_ids), "block": block_bits, "table": [table, len(body)], "planes": planes}
    foot = squeeze.compress(json.dumps(footer).encode())
    return bytes(body) + foot + len(foot).to_bytes(8, "little") + MAGIC


class WaveletFile:
    """Reads one shard from a seekable file; only the blocks asked for are read."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a wavelet file")
        length = int.from_bytes(tail[:8], "little")
        foot = json.loads(zstandard.decompress(self._at(size - 16 - length, length)))
        self.n, self.docs, self.block, self.table, self.planes = (foot[k] for k in ("n", "docs", "block", "table", "planes"))
        self.width = len(self.planes)

    def _at(self, offset, length):
        self.file.seek(offset)
        return self.file.read(length)

    def _bits(self, level, block):
        offsets = self.planes[level]["offsets"]
        raw = zstandard.decompress(self._at(offsets[block], offsets[block + 1] - offsets[block]))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=min(self.block, self.n - block * self.block))

    def documents(self) -> tuple[list, np.ndarray]:
        """(document ids, lengths)."""
        raw = zstandard.decompress(self._at(self.table[0], self.table[1] - self.table[0]))
        head = (self.docs + 7) // 8
        missing = np.unpackbits(np.frombuffer(raw[:head], np.uint8), count=self.docs)
        known, lengths = np.frombuffer(raw, np.int64, offset=head).reshape(2, -1) if self.docs else (np.zeros(0, np.int64),) * 2
        return [None if m else int(d) for m, d in zip(missing, known)], lengths

    def _rank1(self, level, i):
        block, rest = divmod(i, self.block)
        ones = self.planes[level]["ones"][block]
        return ones + int(np.count_nonzero(self._bits(level, block)[:rest])) if rest else ones

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(self._bits(level, i // self.block)[i % self.block])
            ones = self._rank1(level, i)
            i = plane["zeros"] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token, begin, end):
        """The positions below the last plane that hold ``token`` of [begin, end)."""
        if token >> self.width or not self.n:
            return 0, 0
        for level, plane in enumerate(self.planes):
            a, b = self._rank1(level, begin), self._rank1(level, end)
            if token >> (self.width - 1 - level) & 1:
                begin, end = plane["zeros"] + a, plane["zeros"] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` comes before position ``i``."""
        begin, end = self._range(token, 0, i)
        return end - begin

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the ``k``-th (from 0) occurrence of ``token``."""
        begin, end = self._range(token, 0, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        i = begin + k
        for level in range(self.width - 1, -1, -1):
            plane, bit = self.planes[level], token >> (self.width - 1 - level) & 1
            nth = i - plane["zeros"] if bit else i
            ones = np.asarray(plane["ones"], np.int64)
            before = ones if bit else np.minimum(np.arange(len(ones), dtype=np.int64) * self.block, self.n) - ones
            block = int(np.searchsorted(before, nth, side="right")) - 1
            i = block * self.block + int(np.flatnonzero(self._bits(level, block) == bit)[nth - before[block]])
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids, put together from the last plane up."""
        expand = zstandard.ZstdDecompressor()
        values = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            zeros, offsets, before = (self.planes[level][k] for k in ("zeros", "offsets", "ones"))
            plane = self._at(offsets[0], offsets[-1] - offsets[0])
            high, above = values.dtype.type(1 << (self.width - 1 - level)), np.empty_like(values)
            for i, begin in enumerate(range(0, self.n, self.block)):
                raw = expand.decompress(plane[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]])
                bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=min(self.block, self.n - begin)).view(bool)
                some = above[begin : begin + len(bits)]
                some[np.flatnonzero(~bits)] = values[begin - before[i] : begin + len(bits) - before[i + 1]]
                some[np.flatnonzero(bits)] = values[zeros + before[i] : zeros + before[i + 1]] | high
            values = above
        return values.astype(np.uint32)


_MANIFEST = "part int, shard int, path string, docs long, tokens long, start_in_part long"


def write_shards(
    docs: DataFrame,
    directory: str,
    tokenizer: str,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    shard_tokens: int = 1 << 21,
    partitions: int | None = None,
    special_tokens: bool = False,
) -> DataFrame:
    """Encode and write all documents; one row per file.

    Strings of added tokens are ordinary text, or with ``special_tokens`` the token's id, the library's default.

    A range of ids goes to each of ``partitions`` tasks (by default as many as Spark shuffles into), which writes a file
    whenever ``shard_tokens`` ids have come together. A task holds one shard, or one document if that is longer.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def write(batches):
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        encode = tokens.encoder(tokenizer, special_tokens).encode
        ids, names, lengths, held = [], [], [], 0

        def flush():
            path = f"{directory}/part-{part:06d}-{shard:05d}.wm"
            n = np.concatenate(lengths)
            storage.write_file(path, build(np.concatenate(ids), names, n))
            row = pa.RecordBatch.from_pylist(
                [{"part": part, "shard": shard, "path": path, "docs": len(names), "tokens": held, "start_in_part": start}],
                schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("start_in_part", pa.int64())]),
            )
            return row

        for batch in texts.slices(batches, "text", 1 << 20):
            found, n = tokens.ended(*encode(texts.texts_of(batch, "text")), end_id)
            ids.append(found)
            names += batch.column("id").to_pylist()
            lengths.append(n)
            held += len(found)
            if held >= shard_tokens:
                yield flush()
                shard, start = shard + 1, start + held
                ids, names, lengths, held = [], [], [], 0
        if names:
            yield flush()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    order = ["id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions or texts.partitions(spark), *order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(write, _MANIFEST), "wavelet-manifest")


def read_documents(manifest: DataFrame, token_counts: tuple[int, ...] = ()) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``,
    ``shard_path``, and ``token_counts``: a map of the asked ids to their number in the whole shard."""
    spark = manifest.sparkSession
    ship_package(spark)
    totals = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    # One row per task of the writing job.
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    files = manifest.join(bases, "part").select("path", (F.col("base") + F.col("start_in_part")).alias("start"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with storage.open_file(row["path"]) as file:
                    shard = WaveletFile(file)
                    ids, (names, lengths) = shard.ids(), shard.documents()
                    counts = [(t, shard.count(t)) for t in token_counts]
                ends = np.cumsum(lengths)
                begins = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array(row["start"] + begins, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)], pa.int64()),
                        pa.array([row["path"]] * len(names), pa.string()),
                        pa.array([counts] * len(names), pa.map_(pa.int64(), pa.int64())),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard_path", "token_counts"],
                )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard_path string, token_counts map<long,long>"
    return files.repartition(texts.partitions(spark), "path").mapInArrow(read, schema)
