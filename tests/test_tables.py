"""Order keys from 2^20 on: the bits of a shipment's four keys no longer fit in a long."""

import hashlib
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from logloom.plans import set_queries as q
from logloom.sources.tables import lineitem_logs

SCHEMA = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_returnflag string, l_linestatus string"


def write(spark, path, first_order, seed=3):
    """200 shipments; those without a key have no number."""
    rng = random.Random(seed)
    rows = set()
    while len(rows) < 200:
        keys = (first_order + rng.randrange(20) * 500_000, rng.randrange(1, 8), rng.randrange(30), rng.randrange(70_000))
        rows.add((*keys, datetime(1995, 1, 1) + timedelta(days=rng.randrange(9)), "N", "O"))
    rows = [*rows, (None, 1, 1, None, datetime(1995, 1, 1), "N", "O"), (first_order, 1, 1, None, None, "N", "O")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/lineitem.parquet")
    return rows


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines"))
    rows = write(spark, path, 1 << 23)
    # Places in the order of all keys, counting from 1; a missing key comes first.
    placed = sorted(rows, key=lambda r: [(v is not None, v) for v in r[:4]])
    return path, [(f"supplier-{r[3] % 16}", place, r) for place, r in enumerate(placed, 1) if None not in r[:4]]


def test_numbers_follow_the_keys(spark, large):
    path, want = large
    logs = lineitem_logs(spark, path)
    got = [tuple(r) for r in logs.where("seq IS NOT NULL").select("source", "seq", "message").collect()]
    assert sorted(got) == sorted((source, seq, f"part {r[2]}") for source, seq, r in want)
    assert logs.count() == 202 and logs.where("seq IS NULL").count() == 2


def test_small_keys_keep_their_bits(spark, tmp_path):
    rows = write(spark, str(tmp_path), 1)
    rows = [r for r in rows if None not in r[:4] and r[0] < 1 << 20]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/small/lineitem.parquet")
    got = sorted(r["seq"] for r in lineitem_logs(spark, f"{tmp_path}/small").collect())
    assert got == sorted((r[0] * 8 + r[1]) * 2**40 + r[2] * 2**16 + r[3] for r in rows) and got


def test_sample_nth_of_large_keys(spark, large):
    by_source = defaultdict(list)
    for source, seq, _ in large[1]:
        by_source[source].append(seq)
    got = sorted(map(tuple, q.sample_nth(spark, large[0]).collect()))
    assert got == sorted((source, seq) for source, seqs in by_source.items() for seq in seqs[6::7]) and got


def test_sample_rate_of_large_keys(spark, large):
    def chosen(source, seq):
        return int(hashlib.md5(f"42:{source}:{seq}".encode()).hexdigest()[:8], 16) / 2**32 < 0.1

    got = sorted(map(tuple, q.sample_rate(spark, large[0]).collect()))
    assert got == sorted((source, seq) for source, seq, _ in large[1] if chosen(source, seq)) and got


def test_sort_logs_of_large_keys(spark, large):
    got = [tuple(r) for r in q.sort_logs(spark, large[0]).where("source IS NOT NULL").orderBy("rank").collect()]
    placed = sorted((source, r[4], seq) for source, seq, r in large[1])
    # The two rows without a supplier come first.
    assert got == [(source, seq, rank) for rank, (source, _, seq) in enumerate(placed, 3)]


def test_top_messages_overall_of_large_keys(spark, large):
    counts = Counter(r[2] for _, _, r in large[1])
    counts.update([1, 1])  # the rows without a supplier
    first = {}
    for source, seq, r in sorted(large[1], key=lambda x: x[:2]):
        first.setdefault(r[2], (source, seq))
    first[1] = ("", 0)
    want = sorted(counts, key=lambda part: (-counts[part], first[part]))[:20]
    assert [tuple(r) for r in q.top_messages_overall(spark, large[0]).collect()] == [(f"part {p}", counts[p]) for p in want]
