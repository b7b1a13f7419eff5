import re

import pytest
from pyspark.sql import functions as F

from logloom.functions.regex import java_pattern, java_replacement
from logloom.operators import rewrite as w
from logloom.operators.rules import MaskRule, NormalizeRule, RedactRule, RuleError, TransformRule


def one(df):
    return df.collect()[0]


PATTERNS = [
    (r"(?P<user>\w+)@(\w+)", r"\g<user> at \2", "Bob@HOST and élan@x"),
    (r"([a-z])\1", r"<\1\1>", "aA bb éé"),
    (r"[[&]+", "#", "a[b&&c"),
    (r"[]x]+", "#", "]x-X"),
    (r"[^]]", "#", "a]b"),
    (r"(\d)(\d)", r"\2\g<1>0", "12 ٣٤ 56"),
    (r"cost", "$1\\\\", "cost COST"),
    (r"(?P<q>['\"]).*?(?P=q)", "Q", "a 'b' \"c\""),
    (r"x*", "-", "abxd"),
    (r"end\Z", "E", "end end"),
    (r"a.c", "!", "a\rc a\nc a c"),
    (r"\bé\b", "e", "é né"),
    (r"(?#note)\s+", "_", "a  b\tc"),
]


def test_dialect(spark):
    for pattern, replacement, text in PATTERNS:
        df = spark.createDataFrame([(text,)], "t string")
        out = one(df.select(F.regexp_replace("t", java_pattern(pattern), java_replacement(replacement, pattern)).alias("o")))
        assert out["o"] == re.sub(pattern, replacement, text, flags=re.IGNORECASE), pattern


def test_transform_chain(logs):
    df = logs([dict(message="Hello 1", level="info", raw="R", service=None)])
    rules = [TransformRule("message", "hello", "hi"), TransformRule("message", "hi", "hey"), TransformRule("service", "x", "y")]
    row = one(w.transform_logs(df, [*rules, TransformRule("level", "I", "1"), w.redact_pattern(r"\d+")]))
    assert (row["message"], row["service"], row["level"], row["raw"]) == ("hey [REDACTED]", None, "1nfo", "R")
    assert w.transform_logs(df, []).collect() == df.collect()
    row = one(w.transform_logs(df, [TransformRule("message", "hello", "x", ignore_case=False)]))
    assert row["message"] == "Hello 1"


def test_redact(logs):
    df = logs([dict(message="mail a@b.co", raw="secret", extra={"user": "A@B.CO", "n": "1"})])
    rules = [
        RedactRule("email", r"\S+@\S+", "[EMAIL]", ("message", "user", "gone")),
        RedactRule("mask", r"\[EMAIL\]", "[MASKED]"),
    ]
    row = one(w.redact_logs(df, rules))
    assert row["message"] == "mail [MASKED]" and row["extra"] == {"user": "[EMAIL]", "n": "1"} and row["raw"] is None


def test_mask_conditions_see_the_input(logs):
    df = logs([dict(message="token", level="info", extra={"k": "v"})])
    rules = [MaskRule("a", ("message",)), MaskRule("b", ("k", "gone"), "X", F.col("message") == "token")]
    row = one(w.mask_logs(df, rules))
    assert row["message"] == "***" and row["extra"] == {"k": "X"} and row["raw"] is None
    row = one(w.mask_logs(df, [MaskRule("c", ("message",), condition="level = 'error'")]))
    assert row["message"] == "token"


def test_normalize(logs):
    df = logs([dict(message="\x1b[31mred\x1b[0m", level="warn", service="API", raw="r"), dict(message="m", level="", service=None)])
    rules = [
        w.uppercase_level_rule(),
        w.lowercase_service_rule(),
        w.strip_ansi_rule(),
        NormalizeRule("level", lambda c: F.concat(c, F.lit("!"))),
    ]
    a, b = w.normalize_logs(df, rules).orderBy("seq").collect()
    assert (a["level"], a["service"], a["message"], a["raw"]) == ("WARN!", "api", "red", "r")
    assert (b["level"], b["service"]) == ("", None)


def test_truncate(logs):
    df = logs([dict(message="x" * 20, extra={"d": "é" * 30, "s": "ok"}), dict(message="y" * 10)])
    a, b = w.truncate_logs(df, 10, fields=["d", "gone"]).orderBy("seq").collect()
    assert a["message"] == "x" * 7 + "..." and a["extra"] == {"d": "é" * 7 + "...", "s": "ok"}
    assert b["message"] == "y" * 10
    assert one(w.truncate_logs(df, 8, ">").orderBy("seq"))["message"] == "x" * 7 + ">"


def test_mark(logs):
    df = logs([dict(message="Error: an (error) a.b aXb")])
    assert one(w.mark_logs(df, "error"))["message"] == "<mark>Error</mark>: an (<mark>error</mark>) a.b aXb"
    assert one(w.mark_logs(df, "a.B", "$", "\\"))["message"] == "Error: an (error) $a.b\\ aXb"
    assert one(w.mark_logs(df, ""))["message"] == "Error: an (error) a.b aXb"


@pytest.mark.parametrize(
    "build",
    [
        lambda: TransformRule("timestamp", "a", "b"),
        lambda: TransformRule("message", "(", "b"),
        lambda: RedactRule("", "a"),
        lambda: RedactRule("n", ""),
        lambda: RedactRule("n", "[z"),
        lambda: MaskRule("", ("message",)),
        lambda: MaskRule("n", ()),
        lambda: MaskRule("n", ("message",), condition=7),
        lambda: NormalizeRule("extra", str),
        lambda: NormalizeRule("", str),
        lambda: NormalizeRule("level", "upper"),
    ],
)
def test_bad_rules(build):
    with pytest.raises(RuleError):
        build()


@pytest.mark.parametrize("size,tail", [(0, "."), (-1, "."), (3, "..."), (2, "...")])
def test_bad_truncation(logs, size, tail):
    with pytest.raises(RuleError):
        w.truncate_logs(logs([dict()]), size, tail)
