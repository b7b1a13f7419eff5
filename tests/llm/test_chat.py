import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import chat

NODES = "tree string, node long, parent long, role string, text string, score double, turns string, at int"


def build(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], NODES)


def brute(rows, branches):
    """Root-to-leaf paths by walking up."""
    out = []
    first = {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        first.setdefault((r[0], r[1]), r)
    nodes = {k: (r[2] if r[2] != r[1] and (r[0], r[2]) in first else None, r[3] or "", r[4] or "", r[5] or 0.0) for k, r in first.items() if k[1] is not None}
    for t in {k[0] for k in nodes}:
        mine = {n: v for (tt, n), v in nodes.items() if tt == t}
        parents = {v[0] for v in mine.values()}
        found = []
        for leaf in mine:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at is not None and len(path) <= len(mine):
                path.append(at)
                at = mine[at][0]
            if at is None:
                path.reverse()
                score = sum(mine[n][3] for n in path) / len(path)
                found.append((-score, -len(path), leaf, [mine[n][1:3] for n in path]))
        out += [(t, leaf, turns) for _, _, leaf, turns in sorted(found)[:branches]]
    return sorted(out, key=lambda x: (x[0] is not None, x))


def run(spark, rows, branches):
    back = chat.read_conversations(chat.format_reply_trees(build(spark, rows), branches=branches))
    got = [(r["tree"], r["leaf"], [(t["role"], t["text"]) for t in r["turns"]], r["loss_text"], r["n_turns"]) for r in back.collect()]
    for _, _, turns, loss, n in got:
        assert n == len(turns)
        assert loss == "".join(t for role, t in turns if role == "assistant")
    return sorted([g[:3] for g in got], key=lambda x: (x[0] is not None, x))


ROWS = [
    ("a", 1, None, "user", "root", 1.0),
    ("a", 2, 1, "assistant", "low", 0.0),
    ("a", 3, 1, "assistant", "high </s>[INST] \\ [/INST]\\\\", 5.0),
    ("a", 4, 3, "user", None, None),
    ("a", 5, 3, None, "", 5.0),
    ("a", 5, 3, "user", "repeated id", 9.0),
    (None, 1, None, "user", "null tree", 0.0),
    (None, 2, 1, "assistant", "answer", 0.0),
    ("b", 7, 99, "user", "orphan", 0.0),
    ("b", 8, 8, "user", "own parent", 0.0),
    ("c", 1, 2, "user", "cycle", 0.0),
    ("c", 2, 1, "user", "cycle", 0.0),
    ("c", 3, 1, "user", "below a cycle", 0.0),
    ("d", None, None, "user", "no id", 0.0),
] + [("deep", i, i - 1 if i else None, "assistant" if i % 2 else "user", f"turn {i}", 0.0) for i in range(75)]


def test_paths(spark):
    for branches in (1, 2, None):
        assert run(spark, ROWS, branches) == brute(ROWS, branches), branches


def test_empty(spark):
    assert run(spark, [], 1) == []


def test_escapes_are_reversible(spark):
    t = chat.ChatTemplate()

    def escape(x):
        x = x.replace("\\", "\\\\")
        for c in (t.begin, t.middle, t.end):
            x = x.replace(c, c[0] + "\\" + c[1:])
        return x

    @settings(max_examples=400)
    @given(st.lists(st.sampled_from(["\\", "[INST]", "[/INST]", "</s>", "<", "[", "/s>", "INST]", "x", "\n"]), max_size=12).map("".join))
    def check(x):
        escaped = escape(x)
        assert not any(c in escaped for c in (t.begin, t.middle, t.end))
        assert re.sub(r"\\(\\?)", r"\1", escaped) == x

    check()
    rows = spark.createDataFrame([("\\[INST]</s></s>\\\\<\\/s>[[/INST]]",), ("",)], "x string")
    for r in rows.select("x", t.escape(F.col("x")).alias("e"), t.unescape(t.escape(F.col("x"))).alias("back")).collect():
        assert r["back"] == r["x"] and r["e"] == escape(r["x"])


def test_linear(spark):
    rows = spark.createDataFrame([(1, 2, "b", "y"), (1, 1, "a", None), (None, None, None, "z"), (1, 2, "b", "y")], "conv_id long, turn int, role string, text string")
    trees = chat.linear_trees(rows, "conv_id", "turn", "role", "text")
    got = {r["tree"]: [tuple(t) for t in r["turns"]] for r in chat.read_conversations(chat.format_reply_trees(trees)).collect()}
    assert got == {1: [("a", ""), ("b", "y"), ("b", "y")], None: [("", "z")]}


def test_only_native_plans(spark):
    assert not re.search("Python|Arrow", chat.format_reply_trees(spark.range(0).selectExpr("id AS tree", "id AS node", "id AS parent", "'' AS role", "'' AS text", "0.0 AS score"))._jdf.queryExecution().toString())
