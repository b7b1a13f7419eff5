"""Ready-made compositions over raw lines ``(source, seq, raw)``, with their usual defaults.

The tail is cut before parsing and filtering: it counts raw lines. Anything that depends on order comes after
the filters.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.formats import plain_line, text_line
from logloom.functions.text import contains_ci, equals_ci
from logloom.operators import aggregate, ordered, rewrite, stateful, tag
from logloom.operators.filters import filter_logs, level_equals
from logloom.operators.parse import parse_logs
from logloom.operators.rules import AlertRule, MaskRule, RuleError, SplitRule, TransformRule


def _recent(lines: DataFrame, tail: int | None) -> DataFrame:
    return parse_logs(lines if tail is None else ordered.tail_logs(lines, tail))


def _with_line(df: DataFrame, line: Column | None = None) -> DataFrame:
    return df.withColumn("line", plain_line() if line is None else line)


def browse(lines: DataFrame, tail: int = 100, level: str | None = None, search: str | None = None, mark=False):
    """Recent lines that pass the filters, formatted; with ``mark`` the search term is wrapped."""
    found = filter_logs(_recent(lines, tail), search, level=level)
    return _with_line(rewrite.mark_logs(found, search) if mark and search else found)


def export(lines: DataFrame, tail: int = 200, level: str | None = None, search: str | None = None) -> DataFrame:
    """Recent rows that pass the filters, to be written with :func:`logloom.sinks.files.write_logs`."""
    return filter_logs(_recent(lines, tail), search, level=level)


def stats(lines: DataFrame, tail: int = 500) -> DataFrame:
    return aggregate.stats(_recent(lines, tail))


def stats_top(lines: DataFrame, tail: int = 500, top: int = 5, level: bool = True, service: bool = True) -> DataFrame:
    """``source, kind, value, count``: the ``top`` most frequent levels and services of recent lines."""
    logs = _recent(lines, tail)
    parts = []
    for wanted, kind, counts in ((level, "level", aggregate.level_breakdown), (service, "service", aggregate.service_breakdown)):
        if wanted:
            found = counts(logs, top=top)
            parts.append(found.select("source", F.lit(kind).alias("kind"), F.col(kind).alias("value"), "count"))
    if not parts:
        raise RuleError("nothing to break down by")
    return reduce(DataFrame.unionByName, parts)


def top_messages(lines: DataFrame, tail: int = 500, top: int = 5) -> DataFrame:
    return aggregate.top_messages(_recent(lines, tail), top)


def alert(
    lines: DataFrame,
    level: str = "ERROR",
    keyword: str | None = None,
    threshold: int = 1,
    window: float = 60,
    rule_name: str = "alert",
    tail: int | None = None,
) -> DataFrame:
    rule = AlertRule(level, keyword, threshold, window, rule_name)
    return stateful.alert_logs(_recent(lines, tail), [rule])


def replay(
    lines: DataFrame, level: str | None = None, search: str | None = None, exact: str | None = None, plain: bool = False
) -> DataFrame:
    """Saved lines that pass the filters, as ``[timestamp] message`` or, ``plain``, as level lines; ``search`` is fuzzy.

    :func:`logloom.operators.aggregate.match_count` counts them.
    """
    found = filter_logs(parse_logs(lines), exact, level=level)
    return _with_line(filter_logs(found, search, fuzzy=True) if search else found, plain_line() if plain else text_line())


def sample(
    lines: DataFrame,
    every_nth: int = 1,
    rate: float = 1.0,
    level: str | None = None,
    search: str | None = None,
    tail: int = 100,
    seed: int = 0,
) -> DataFrame:
    found = filter_logs(_recent(lines, tail), search, fuzzy=True, level=level)
    return _with_line(ordered.sample_logs(found, every_nth, rate, seed))


def dedup(
    lines: DataFrame,
    window: int = 256,
    max_repeats: int = 1,
    level: str | None = None,
    search: str | None = None,
    tail: int = 100,
) -> DataFrame:
    found = filter_logs(_recent(lines, tail), search, level=level)
    return _with_line(stateful.dedup_logs(found, window, max_repeats))


def dedup_report(
    lines: DataFrame,
    window: int = 256,
    max_repeats: int = 1,
    level: str | None = None,
    search: str | None = None,
    tail: int = 100,
) -> DataFrame:
    """The lines that :func:`dedup` holds back, with the ``occurrence`` of their message."""
    found = filter_logs(_recent(lines, tail), search, level=level)
    return _with_line(stateful.suppressed_logs(found, window, max_repeats))


def aggregate_windows(
    lines: DataFrame, window: int = 60, level: str | None = None, search: str | None = None, tail: int = 200
) -> DataFrame:
    found = filter_logs(_recent(lines, tail), search, level=level)
    return _with_line(aggregate.tumbling_counts(found, window), aggregate.bucket_line())


def _replacement(spec: str) -> TransformRule:
    """``FIELD:PATTERN:REPLACEMENT``, split at the first two colons."""
    parts = spec.split(":", 2)
    if len(parts) != 3:
        raise RuleError(f"expected FIELD:PATTERN:REPLACEMENT, got {spec!r}")
    return TransformRule(*parts)


def transform(lines: DataFrame, redact: Sequence[str] = (), replace: Sequence[str] = (), tail: int = 100) -> DataFrame:
    """Redactions first, then replacements, each in the order given."""
    rules = [rewrite.redact_pattern(p) for p in redact] + [_replacement(spec) for spec in replace]
    return _with_line(rewrite.transform_logs(_recent(lines, tail), rules))


def correlate(
    lines: DataFrame, field: str = "trace_id", window: float = 5.0, min_size: int = 2, tail: int = 200
) -> DataFrame:
    return aggregate.correlation_groups(_recent(lines, tail), field, window, min_size)


def annotate(lines: DataFrame, tags: Sequence[str], level: str | None = None, tail: int = 100) -> DataFrame:
    """``TAG:PATTERN`` tags; the line ends with all extra values as ``[key=value]``, keys in order."""
    rules = [tag.annotation_from_spec(spec) for spec in tags]
    logs = _recent(lines, tail)
    logs = tag.annotate_logs(level_equals(logs, level) if level else logs, rules)
    shown = F.transform(
        F.sort_array(F.map_entries("extra")), lambda e: F.concat(F.lit(" ["), e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit("]"))
    )
    return _with_line(logs, F.concat(plain_line(), F.array_join(shown, "")))


def rate_limit(
    lines: DataFrame, max_per_second: float = 10.0, level: str | None = None, search: str | None = None, tail: int = 100
) -> DataFrame:
    found = filter_logs(_recent(lines, tail), search, fuzzy=True, level=level)
    return _with_line(stateful.rate_limit_logs(found, max_per_second))


def route(
    lines: DataFrame,
    keywords: Sequence[str] = (),
    levels: Sequence[str] = (),
    stop: bool = False,
    tail: int = 100,
) -> DataFrame:
    """One ``[label] line`` per route taken; keyword routes come before level routes."""
    routes = [tag.keyword_route(s, stop) for s in keywords] + [tag.level_route(s, stop) for s in levels]
    routed = tag.explode_routes(_recent(lines, tail), routes)
    return _with_line(routed, F.concat(F.lit("["), F.col("route"), F.lit("] "), plain_line()))


def split(
    lines: DataFrame,
    levels: Sequence[str] = (),
    keywords: Sequence[str] = (),
    catch_all: str = "default",
    tail: int = 100,
) -> DataFrame:
    """Rows with their bucket; level rules come before keyword rules."""
    rules = [SplitRule(v.lower(), equals_ci(F.col("level"), v)) for v in levels]
    rules += [SplitRule(k.lower(), contains_ci(F.col("message"), k)) for k in keywords]
    return tag.split_logs(_recent(lines, tail), rules, catch_all)


def enrich(
    lines: DataFrame,
    add_host: bool = True,
    add_index: bool = False,
    level: str | None = None,
    search: str | None = None,
    tail: int = 100,
) -> DataFrame:
    found = filter_logs(_recent(lines, tail), search, level=level)
    found = tag.enrich_logs(found, [tag.host_rule()]) if add_host else found
    return _with_line(tag.add_index(found) if add_index else found)


def mask(
    lines: DataFrame,
    fields: Sequence[str] = ("message",),
    mask_with: str = "***",
    level: str | None = None,
    search: str | None = None,
    tail: int = 100,
) -> DataFrame:
    found = filter_logs(_recent(lines, tail), search, level=level)
    return _with_line(rewrite.mask_logs(found, [MaskRule("mask", tuple(fields), mask_with)]))


def classify(
    lines: DataFrame,
    keywords: Sequence[str] = (),
    default_category: str = "uncategorized",
    level: str | None = None,
    tail: int = 100,
) -> DataFrame:
    rules = [tag.category_from_spec(spec) for spec in keywords]
    classified = tag.classify_logs(filter_logs(_recent(lines, tail), level=level), rules, default_category)
    return _with_line(classified, F.concat(F.lit("["), F.col("category"), F.lit("] "), text_line()))


def sequence(
    lines: DataFrame, buffer: int = 50, level: str | None = None, search: str | None = None, tail: int = 200
) -> DataFrame:
    found = filter_logs(_recent(lines, tail), search, fuzzy=True, level=level)
    return _with_line(stateful.sequence_logs(found, buffer))


def tail(lines: DataFrame, backfill: int = 0, level: str | None = None, search: str | None = None) -> DataFrame:
    """The last ``backfill`` rows of each source (all for 0), then the filters."""
    logs = parse_logs(ordered.backfill_logs(lines, backfill))
    return _with_line(filter_logs(logs, search, fuzzy=True, level=level))
