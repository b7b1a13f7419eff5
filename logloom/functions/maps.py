"""Expressions over ``map<string,string>`` columns."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "cast(map() as map<string,string>)"


def empty_map() -> Column:
    return F.expr(EMPTY)


def overlay(base: Column, new: Column) -> Column:
    """``base`` updated with ``new``; keys of ``new`` win. Never raises on shared keys."""
    base = F.coalesce(base, empty_map())
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def present(pairs: dict[str, Column]) -> Column:
    """A map of the given values without those that are NULL."""
    flat = reduce(lambda acc, kv: acc + [F.lit(kv[0]), kv[1].cast("string")], pairs.items(), [])
    return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull())


def replace_values(base: Column, keys: list[str], change) -> Column:
    """Apply ``change`` to the values of ``keys``; keys that are absent are not created."""
    if not keys:
        return base
    return F.transform_values(base, lambda k, v: F.when(k.isin(*keys), change(v)).otherwise(v))


def counts_map(name: Column, count: Column) -> Column:
    """Aggregate: rows of (name, count) to one map with its keys in order. NULL names are left out."""
    pairs = F.sort_array(F.collect_list(F.when(name.isNotNull(), F.struct(name, count))))
    return F.map_from_entries(pairs)
