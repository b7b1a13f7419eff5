"""Operators that change the text of fields. Rules run in order; each sees the result of the one before."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.maps import replace_values
from logloom.functions.regex import literal
from logloom.functions.text import matches
from logloom.operators.rules import MaskRule, NormalizeRule, RedactRule, TransformRule, as_column, require

# Fixed pattern: terminal colour and style codes.
ANSI_PATTERN = r"\x1b\[[0-9;]*m"


def _replaced(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """Replace columns in one projection: every expression reads the input row (``withColumns`` may chain them)."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns])


def transform_logs(df: DataFrame, rules: Sequence[TransformRule]) -> DataFrame:
    """Regex replacement chain. NULL fields stay NULL."""
    changed: dict[str, Column] = {}
    for rule in rules:
        changed[rule.field] = rule.rewrite(changed.get(rule.field, F.col(rule.field)))
    return _replaced(df, changed)


def redact_pattern(pattern: str, replacement: str = "[REDACTED]") -> TransformRule:
    """A rule that replaces ``pattern`` in the message."""
    return TransformRule("message", pattern, replacement)


def _without_raw(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """The original line would give away what was hidden, so it is dropped."""
    return _replaced(df, {**changed, "raw": F.lit(None).cast("string")})


def redact_logs(df: DataFrame, rules: Sequence[RedactRule]) -> DataFrame:
    """Replace secrets in the message and in named extra values; ``raw`` becomes NULL."""
    message, extra = F.col("message"), F.col("extra")
    for rule in rules:
        if "message" in rule.fields:
            message = rule.rewrite(message)
        extra = replace_values(extra, [f for f in rule.fields if f != "message"], rule.rewrite)
    return _without_raw(df, {"message": message, "extra": extra})


def mask_logs(df: DataFrame, rules: Sequence[MaskRule]) -> DataFrame:
    """Replace whole values. Every condition looks at the input row; ``raw`` becomes NULL.

    The conditions are columns of their own first: inside the lambda over ``extra``, a name such as ``message``
    would mean the replaced column of the same projection.
    """
    flags = [f"_mask_{i}" for i in range(len(rules))]
    flagged = df.select("*", *[matches(as_column(r.condition)).alias(f) for r, f in zip(rules, flags)])
    message, extra = F.col("message"), F.col("extra")
    for rule, flag in zip(rules, flags):
        holds, mask = F.col(flag), F.lit(rule.mask_with)
        if "message" in rule.fields:
            message = F.when(holds, mask).otherwise(message)
        keys = [f for f in rule.fields if f != "message"]
        extra = replace_values(extra, keys, lambda v, holds=holds, mask=mask: F.when(holds, mask).otherwise(v))
    return _without_raw(flagged, {"message": message, "extra": extra}).drop(*flags)


def normalize_logs(df: DataFrame, rules: Sequence[NormalizeRule]) -> DataFrame:
    """Apply field functions in order. Empty levels and services are left alone."""
    changed: dict[str, Column] = {}
    for rule in rules:
        value = changed.get(rule.field, F.col(rule.field))
        result = rule.transform(value)
        if rule.field != "message":
            result = F.when(value != "", result).otherwise(value)
        changed[rule.field] = result
    return _replaced(df, changed)


def uppercase_level_rule() -> NormalizeRule:
    return NormalizeRule("level", F.upper)


def lowercase_service_rule() -> NormalizeRule:
    return NormalizeRule("service", F.lower)


def strip_ansi_rule() -> NormalizeRule:
    return NormalizeRule("message", lambda c: F.regexp_replace(c, ANSI_PATTERN, ""))


def truncate_text(text: Column, max_length: int, ellipsis: str = "...") -> Column:
    """Text longer than ``max_length`` cut so that it ends in ``ellipsis`` at exactly that length."""
    cut = F.concat(F.substring(text, 1, max_length - len(ellipsis)), F.lit(ellipsis))
    return F.when(F.length(text) > max_length, cut).otherwise(text)


def truncate_logs(df: DataFrame, max_length: int, ellipsis: str = "...", fields: Sequence[str] = ()) -> DataFrame:
    """Shorten messages and named extra values; ``raw`` becomes NULL."""
    require(max_length > 0, "max_length must be positive")
    require(len(ellipsis) < max_length, "ellipsis must be shorter than max_length")

    def cut(text: Column) -> Column:
        return truncate_text(text, max_length, ellipsis)

    extra = replace_values(F.col("extra"), list(fields), cut)
    return _without_raw(df, {"message": cut(F.col("message")), "extra": extra})


def mark_term(text: Column, term: str, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """Wrap every literal occurrence of ``term``, in any case."""
    if not term:
        return text
    quoted = [m.replace("\\", "\\\\").replace("$", "\\$") for m in (opening, closing)]
    return F.regexp_replace(text, literal(term), f"{quoted[0]}$0{quoted[1]}")


def mark_logs(df: DataFrame, term: str, opening: str = "<mark>", closing: str = "</mark>") -> DataFrame:
    return df.withColumn("message", mark_term(F.col("message"), term, opening, closing))
