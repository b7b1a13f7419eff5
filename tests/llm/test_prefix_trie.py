"""The conversation prefix trie against a direct reading of its definition."""

import hashlib
import re
import zlib

import pytest

from logloom.llm.queries import QUERIES
from logloom.llm.prefix_trie import prefix_trie, rebuilt_turns, weighted_sequences

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Nodes keyed by (conv_id, depth): every row of the contract computed from Python lists."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn if turn is not None else 0, role or "", text or ""))
    ordered = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1], x[2], x[3]))] for c, v in convs.items()}
    rebuilt = {}
    for c in ordered:
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(ordered.get(donor, [])[:h] + ordered[c][h:])
    members = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = {}
    for p, m in members.items():
        kids = [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        sub = [q for q in members if q[: len(p)] == p]
        leaves = sum(1 for q in sub if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members))
        saved = sum((len(members[q]) - 1) * (len(WORDS.findall(q[-1][1])) if q else 0) for q in sub)
        ends = sorted(c for c in m if len(rebuilt[c]) == len(p))
        out[(min(m), len(p))] = (
            min(members[p[:-1]]) if p else None,
            len(m),
            len(kids),
            leaves,
            saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit("x").alias(n) for n in ("conv", "pos", "digest", "words", "seq", "key", "parent", "owner", "depth", "weight", "first")))
    turns, convs = rebuilt_turns(df)
    got = prefix_trie(weighted_sequences(turns, members=convs)).collect()
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}


def test_shared_and_branching(spark):
    talk = [("user", "hi there"), ("assistant", "hello you two"), ("user", "bye"), ("assistant", "ok")]
    rows = []
    for c in range(0, 45):
        n = 1 + c % 4
        rows += [(c, t, *talk[t]) for t in range(n)]
        if c % 7 == 0:
            rows.append((c, 9, "user", f"extra {c} words here"))
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (20, None, "user", "first"), (20, None, None, None), (20, 1, "user", "x"), (20, 1, "user", "x"),  # null turn, ties, repeats
        (21, 0, None, "only"), (22, 5, "assistant", ""), (23, 0, "user", "a b c " * 200),
        (None, 0, "user", "no conversation"), (40, 0, "user", "first"), (41, 0, "user", "first"), (-3, 0, "user", "neg"),
    ]
    assert run(spark, rows, extra=True) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("directory", ["/root/testdata/sf0.001"])
def test_query_against_brute_force(spark, directory):
    rows = [tuple(r) for r in spark.read.parquet(f"{directory}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_prefix_trie"](spark, directory).collect()
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got} == brute(rows)
