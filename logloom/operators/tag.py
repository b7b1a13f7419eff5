"""Operators that add derived values to rows: tags, labels, categories, routes, scores."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.maps import overlay, present
from logloom.functions.text import contains_ci, equals_ci, matches
from logloom.operators.ordered import with_row_number
from logloom.operators.rules import (
    AnnotationRule,
    ClassifyRule,
    EnrichRule,
    LabelRule,
    Route,
    RuleError,
    ScoreRule,
    SplitRule,
    as_column,
)


def _last_match(settings: list[tuple[str, Column, str]]) -> dict[str, Column]:
    """Per key, the value set by the last matching (key, predicate, value); NULL if none matches."""
    values: dict[str, list[Column]] = {}
    for key, pred, value in settings:
        values.setdefault(key, []).insert(0, F.when(pred, F.lit(value)))
    return {key: F.coalesce(*options) for key, options in values.items()}


def _with_overlay(df: DataFrame, new: Column) -> DataFrame:
    """Merge a map into ``extra``. It is a column of its own first, so it is computed once per row."""
    named = df.withColumn("_new", new)
    return named.withColumn("extra", overlay(F.col("extra"), F.col("_new"))).drop("_new")


def _with_extra(df: DataFrame, settings: list[tuple[str, Column, str]]) -> DataFrame:
    if not settings:
        return df
    return _with_overlay(df, present(_last_match(settings)))


def annotate_logs(df: DataFrame, rules: Sequence[AnnotationRule]) -> DataFrame:
    """Set ``extra[tag]`` for every matching rule; predicates see the input row, later rules win."""
    return _with_extra(df, [(r.tag, as_column(r.match), r.value) for r in rules])


def label_logs(df: DataFrame, rules: Sequence[LabelRule]) -> DataFrame:
    """Merge the labels of every matching rule into ``extra``; later rules win."""
    return _with_extra(df, [(k, as_column(r.match), v) for r in rules for k, v in r.labels.items()])


def enrich_logs(df: DataFrame, rules: Sequence[EnrichRule]) -> DataFrame:
    """Set ``extra[key]`` to an expression; each rule sees what the earlier ones set."""

    def step(frame: DataFrame, rule: EnrichRule) -> DataFrame:
        value = F.create_map(F.lit(rule.key), as_column(rule.derive).cast("string"))
        return _with_overlay(frame, value)

    return reduce(step, rules, df)


def host_rule() -> EnrichRule:
    return EnrichRule("host", F.col("source"))


def add_index(df: DataFrame, key: str = "index") -> DataFrame:
    """Set ``extra[key]`` to the row's 1-based position in its source. Filter first: only these rows count."""
    return enrich_logs(with_row_number(df, "_index"), [EnrichRule(key, F.col("_index"))]).drop("_index")


def _first_match(pairs: list[tuple[Column, str]], default: str) -> Column:
    chain = reduce(lambda acc, p: acc.when(*p), [(p, F.lit(v)) for p, v in pairs], F)
    return chain.otherwise(F.lit(default)) if pairs else F.lit(default)


def classify_logs(
    df: DataFrame, rules: Sequence[ClassifyRule], default: str = "uncategorized", column: str = "category"
) -> DataFrame:
    """The category of the first matching rule. A predicate that is NULL is skipped; use ``try_`` functions."""
    return df.withColumn(column, _first_match([(as_column(r.match), r.category) for r in rules], default))


def split_logs(
    df: DataFrame, rules: Sequence[SplitRule], catch_all: str = "default", column: str = "bucket"
) -> DataFrame:
    """The name of the first matching rule as a bucket."""
    return df.withColumn(column, _first_match([(as_column(r.match), r.name) for r in rules], catch_all))


def route_logs(df: DataFrame, routes: Sequence[Route], column: str = "routes") -> DataFrame:
    """The names of the routes each row takes, in order, up to a matching route with ``stop``."""
    taken, open_ = [], F.lit(True)
    for route in routes:
        hit = matches(as_column(route.match))
        taken.append(F.when(open_ & hit, F.lit(route.name)))
        if route.stop:
            open_ = open_ & ~hit
    if not taken:
        return df.withColumn(column, F.expr("cast(array() as array<string>)"))
    return df.withColumn(column, F.array_compact(F.array(*taken)))


def explode_routes(df: DataFrame, routes: Sequence[Route], column: str = "route") -> DataFrame:
    """One row per route taken; rows that take none are left out."""
    return route_logs(df, routes, "_routes").withColumn(column, F.explode("_routes")).drop("_routes")


def score_logs(df: DataFrame, rules: Sequence[ScoreRule], column: str = "score") -> DataFrame:
    """The points of all matching rules added up."""
    points = [F.when(as_column(r.match), F.lit(float(r.points))).otherwise(F.lit(0.0)) for r in rules]
    return df.withColumn(column, reduce(lambda a, b: a + b, points, F.lit(0.0)))


def rank_logs(df: DataFrame, rules: Sequence[ScoreRule], limit: int | None = None) -> DataFrame:
    """Rows by falling score, arrival order among equals. ``limit`` makes it a top-k report."""
    ranked = score_logs(df, rules).orderBy(F.desc("score"), "source", "seq")
    return ranked if limit is None else ranked.limit(limit)


# Rule shorthands: NAME:TEXT strings to rules.


def _halves(spec: str) -> tuple[str, str]:
    if ":" not in spec:
        raise RuleError(f"expected NAME:TEXT, got {spec!r}")
    name, _, text = spec.partition(":")
    return name, text


def annotation_from_spec(spec: str) -> AnnotationRule:
    """``TAG:PATTERN``: the value is the pattern as written."""
    tag, pattern = _halves(spec)
    return AnnotationRule(tag.strip(), contains_ci(F.col("message"), pattern), pattern)


def category_from_spec(spec: str) -> ClassifyRule:
    """``category:pattern``."""
    category, pattern = (part.strip() for part in _halves(spec))
    return ClassifyRule(f"{category}:{pattern.lower()}", contains_ci(F.col("message"), pattern), category)


def keyword_route(spec: str, stop: bool = False) -> Route:
    """``LABEL:PATTERN``."""
    label, pattern = _halves(spec)
    return Route(label, contains_ci(F.col("message"), pattern), stop)


def level_route(spec: str, stop: bool = False) -> Route:
    """``LABEL:LEVEL``."""
    label, level = _halves(spec)
    return Route(label, equals_ci(F.col("level"), level), stop)
