"""Rule objects: a Spark predicate or expression and its parameters, checked when built."""

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.regex import java_pattern, java_replacement


class RuleError(ValueError):
    """A rule or operator was given parameters that make no sense."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise RuleError(message)


def _require_name(value: str, what: str) -> None:
    require(isinstance(value, str) and bool(value.strip()), f"{what} must not be empty")


def _require_predicate(value, what: str) -> None:
    require(isinstance(value, (Column, str)), f"{what} must be a Column or SQL text")


def as_column(value: Column | str) -> Column:
    """Predicates may be given as columns or as SQL text."""
    return F.expr(value) if isinstance(value, str) else value


def _checked_regex(pattern: str) -> None:
    try:
        re.compile(pattern)
    except re.error as exc:
        raise RuleError(f"invalid pattern {pattern!r}: {exc}") from exc


@dataclass(frozen=True)
class TransformRule:
    """Regex replacement in one field."""

    field: str
    pattern: str
    replacement: str
    ignore_case: bool = True

    FIELDS = ("message", "service", "level", "raw")

    def __post_init__(self):
        require(self.field in self.FIELDS, f"field must be one of {self.FIELDS}, got {self.field!r}")
        _checked_regex(self.pattern)

    def rewrite(self, text: Column) -> Column:
        java = java_pattern(self.pattern, self.ignore_case)
        return F.regexp_replace(text, java, java_replacement(self.replacement, self.pattern))


@dataclass(frozen=True)
class RedactRule:
    """Regex replacement in the message and in named extra values."""

    name: str
    pattern: str
    replacement: str = "[REDACTED]"
    fields: tuple[str, ...] = ("message",)

    def __post_init__(self):
        _require_name(self.name, "rule name")
        require(bool(self.pattern), "pattern must not be empty")
        _checked_regex(self.pattern)

    def rewrite(self, text: Column) -> Column:
        return F.regexp_replace(text, java_pattern(self.pattern), java_replacement(self.replacement, self.pattern))


@dataclass(frozen=True)
class MaskRule:
    """Replace whole values where a condition holds."""

    name: str
    fields: tuple[str, ...]
    mask_with: str = "***"
    condition: Column | str = "true"

    def __post_init__(self):
        _require_name(self.name, "rule name")
        require(bool(self.fields), "fields must not be empty")
        _require_predicate(self.condition, "condition")


@dataclass(frozen=True)
class NormalizeRule:
    """Change one field with a ``Column -> Column`` function."""

    field: str
    transform: Callable[[Column], Column]

    FIELDS = ("level", "service", "message")

    def __post_init__(self):
        require(self.field in self.FIELDS, f"field must be one of {self.FIELDS}, got {self.field!r}")
        require(callable(self.transform), "transform must be callable")


@dataclass(frozen=True)
class AnnotationRule:
    """Set one extra value on matching rows."""

    tag: str
    match: Column | str
    value: str = "true"

    def __post_init__(self):
        _require_name(self.tag, "tag")
        _require_predicate(self.match, "match")


@dataclass(frozen=True)
class LabelRule:
    """Set several extra values on matching rows."""

    name: str
    match: Column | str
    labels: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        _require_name(self.name, "rule name")
        _require_predicate(self.match, "match")
        require(isinstance(self.labels, dict) and bool(self.labels), "labels must be a non-empty dict")
        for key, value in self.labels.items():
            require(isinstance(key, str) and bool(key), "label keys must be non-empty strings")
            require(isinstance(value, str), "label values must be strings")


@dataclass(frozen=True)
class EnrichRule:
    """Set one extra value to an expression."""

    key: str
    derive: Column | str

    def __post_init__(self):
        _require_name(self.key, "key")
        _require_predicate(self.derive, "derive")


@dataclass(frozen=True)
class ClassifyRule:
    name: str
    match: Column | str
    category: str

    def __post_init__(self):
        _require_name(self.name, "rule name")
        _require_predicate(self.match, "match")
        _require_name(self.category, "category")


@dataclass(frozen=True)
class SplitRule:
    name: str
    match: Column | str

    def __post_init__(self):
        _require_name(self.name, "rule name")
        _require_predicate(self.match, "match")


@dataclass(frozen=True)
class Route:
    """Send matching rows to a sink. With ``stop`` later routes do not see them."""

    name: str
    match: Column | str
    stop: bool = False
    sink: Callable[[DataFrame], None] | None = None

    def __post_init__(self):
        _require_name(self.name, "route name")
        _require_predicate(self.match, "match")
        require(self.sink is None or callable(self.sink), "sink must be callable")


@dataclass(frozen=True)
class ScoreRule:
    name: str
    match: Column | str
    points: float

    def __post_init__(self):
        _require_name(self.name, "rule name")
        _require_predicate(self.match, "match")
        require(self.points != 0, "points must be non-zero")


@dataclass(frozen=True)
class AlertRule:
    """Fire when ``threshold`` matching rows fall within ``window`` seconds (0: no time limit)."""

    level: str
    keyword: str | None = None
    threshold: int = 1
    window: float = 60
    name: str = "unnamed"

    def __post_init__(self):
        _require_name(self.level, "level")
        require(self.threshold >= 1, "threshold must be >= 1")
        require(self.window >= 0, "window must not be negative")
