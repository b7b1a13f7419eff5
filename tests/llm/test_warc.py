import base64
import hashlib

from pyspark.sql import functions as F

from logloom.checkpoints import scratch_path
from logloom.llm import storage, warc

PAGES = "page_id long, url string, html string, frame string, path string, key string"


def build(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def expected(rows, least=0):
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(largest.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = largest.get(html or "")
        refers = top if len(data) >= least and top is not None and i != top and (sum((h or "") == (html or "") for _, _, h in rows) > 1) else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


ROWS = [
    (1, "http://a/", "<p>same</p>"),
    (2, "http://b/", "<p>same</p>"),
    (3, None, None),
    (4, "x\r\ny: z", ""),
    (5, "http://é/", "\r\n\r\nWARC/1.1\r\n\r\n漢"),
    (6, "http://long/", "<b>" * 400_000),
    (7, "", "<p>same</p>"),
    (7, "again", "<p>same</p>"),
    (None, "no id", "<p>same</p>"),
    (None, "no id", "alone"),
    (8, "http://a/", "other"),
]


def test_round_trip(spark):
    for least in (0, 5):
        index = warc.write_bundles(build(spark, ROWS), scratch_path(spark, "warc-test"), min_bytes=least, frame_bytes=200, bundle_bytes=600)
        got = warc.read_bundles(index, with_payload=True).collect()
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        assert order([r[c] for c in columns] for r in got) == order(expected(ROWS, least))
        html = {i: (h or "").encode() for i, _, h in ROWS if i is not None}
        assert all(r["payload"] == html[r["page_id"]] for r in got if r["record_type"] == "response" and r["page_id"] is not None)
        some = index.where(F.col("page_id").isin(5, 6))
        assert {r["page_id"]: r["payload"] for r in warc.fetch(some).collect()} == {5: html[5], 6: html[6]}


def test_frames_stand_alone(spark):
    import zstandard

    index = warc.write_bundles(build(spark, ROWS[:5]).coalesce(1), scratch_path(spark, "warc-test"), frame_bytes=300)
    path = index.first()["path"]
    with storage.open_file(path) as file:
        reader = warc.BundleReader(file)
        frames = [reader.frame(i) for i in range(len(reader.sizes))]
        file.seek(0)
        whole = zstandard.ZstdDecompressor().stream_reader(file.read(), read_across_frames=True).read()
    assert len(frames) > 1 and b"".join(frames) == whole


def test_empty(spark):
    index = warc.write_bundles(build(spark, []), scratch_path(spark, "warc-test"))
    assert warc.read_bundles(index).count() == 0


def test_bundles_are_read_by_many_tasks(spark):
    from logloom.checkpoints import scratch_path

    index = warc.write_bundles(build(spark, ROWS), scratch_path(spark, "warc-test"), frame_bytes=200, bundle_bytes=600)
    bundles = index.select("path").distinct().count()
    assert bundles > 1
    assert warc._bundles(index).rdd.getNumPartitions() == min(bundles, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert warc.read_bundles(index).count() == len(ROWS)
