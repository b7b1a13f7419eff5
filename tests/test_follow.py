"""Reading log files at the byte: splits, tails from the end, and streams that follow growing files."""

import gzip
import io

import pytest

from logloom.sources import follow
from logloom.sources.files import read_lines


class Counting(io.BytesIO):
    """A file in memory that counts the bytes read from it."""

    def __init__(self, data):
        super().__init__(data)
        self.taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_tail_reads_no_more_for_a_longer_file():
    taken = []
    for lines in (10_000, 1_000_000):
        data = b"".join(b"line %d of the log\n" % i for i in range(lines))
        handle = Counting(data)
        start = follow._last_lines_start(handle, len(data), 100)
        assert data[start:].count(b"\n") == 100 and data[start:].startswith(b"line %d " % (lines - 100))
        taken.append(handle.taken)
    assert taken[0] == taken[1] < 70_000


@pytest.mark.parametrize("n", [1, 2, 3, 5, 50])
def test_tail_edges(n):
    for data in (b"", b"a", b"a\n", b"a\r\nb\rc\n\nd", b"\n\n\n", b"x" * 200_000 + b"\ny"):
        start = follow._last_lines_start(io.BytesIO(data), len(data), n)
        lines = [line for _, line in follow._lines_of(data, 0)]
        assert [line for _, line in follow._lines_of(data[start:], start)] == lines[-n:]


def test_whole_files_equal_the_text_reader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(follow, "SPLIT_BYTES", 7)
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_bytes(b"one\r\ntwo\rthree\n\nfour \xff five\nlast without end")
    (folder / "b.log").write_bytes(b"")
    (folder / "c.log").write_bytes(b"x" * 50 + b"\n" + b"y" * 3)
    (folder / "_SUCCESS").write_bytes(b"not a log\n")
    follow.register(spark)
    got = spark.read.format("logfiles").load(str(folder)).collect()
    for name in ("a.log", "c.log"):
        expected = [r.value for r in spark.read.text(str(folder / name)).collect()]
        mine = sorted((r.seq, r.raw) for r in got if r.file.endswith(name))
        assert [raw for _, raw in mine] == expected
        assert len({s for s, _ in mine}) == len(mine)
    assert {r.source for r in got} == {"a", "c"}


def test_missing_path(spark, tmp_path):
    follow.register(spark)
    with pytest.raises(Exception):
        spark.read.format("logfiles").load(str(tmp_path / "nothing")).collect()


def test_tail_of_rotated_source(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    with gzip.open(folder / "app.log.2.gz", "wb") as f:
        f.write(b"".join(b"old %d\n" % i for i in range(10)))
    (folder / "app.log.1").write_bytes(b"".join(b"mid %d\n" % i for i in range(3)))
    (folder / "app.log").write_bytes(b"new 0\nnew 1")
    (folder / "db.log").write_bytes(b"db 0\ndb 1\ndb 2\n")
    got = read_lines(spark, f"file://{folder}", tail=7).orderBy("source", "seq").collect()
    assert [(r.source, r.raw) for r in got] == [("app", f"old {i}") for i in (8, 9)] + [("app", f"mid {i}") for i in range(3)] + [
        ("app", "new 0"),
        ("app", "new 1"),
    ] + [("db", f"db {i}") for i in range(3)]


def test_follow_growth(spark, tmp_path):
    folder, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "app.log").write_bytes(b"a0\na1\na2\n")
    stream = follow.follow_lines(spark, str(folder), backfill=2).writeStream.format("parquet").option("checkpointLocation", state).start(out)
    try:
        stream.processAllAvailable()
        with open(folder / "app.log", "ab") as f:
            f.write(b"a3\r\na4\npart")
        (folder / "new.log").write_bytes(b"n0\n")
        stream.processAllAvailable()
        first = sorted((r.file.rsplit("/", 1)[1], r.seq, r.raw) for r in spark.read.parquet(out).collect())
        with open(folder / "app.log", "ab") as f:
            f.write(b"ial\n")
        stream.processAllAvailable()
        (folder / "new.log").write_bytes(b"")  # shrunk: read again from its start
        stream.processAllAvailable()
        (folder / "new.log").write_bytes(b"m0\n")
        stream.processAllAvailable()
    finally:
        stream.stop()
    assert first == [("app.log", 3, "a1"), ("app.log", 6, "a2"), ("app.log", 9, "a3"), ("app.log", 13, "a4"), ("new.log", 0, "n0")]
    got = sorted((r.file.rsplit("/", 1)[1], r.seq, r.raw) for r in spark.read.parquet(out).collect())
    assert got == sorted(first + [("app.log", 16, "partial"), ("new.log", 0, "m0")])


def test_restart_takes_up_where_it_stopped(spark, tmp_path):
    folder, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "app.log").write_bytes(b"a0\na1\n")

    def run():
        stream = follow.follow_lines(spark, str(folder), backfill=1).writeStream.format("parquet").option("checkpointLocation", state).start(out)
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()

    run()
    with open(folder / "app.log", "ab") as f:
        f.write(b"a2\na3\n")
    run()
    got = sorted((r.seq, r.raw) for r in spark.read.parquet(out).collect())
    assert got == [(3, "a1"), (6, "a2"), (9, "a3")]
