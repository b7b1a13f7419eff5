"""Keyword rules by the thousand: one multi-pattern automaton per table of rules, one pass over each text.

A rule is ``(rule_id, keyword, category)``; it matches a text that contains its keyword, ignoring case (both are lowered
by Python's ``str.lower``). Rules are read from a DataFrame in order of ``rule_id`` and built into Aho-Corasick
automata (goto and failure links in the C arrays of ``pyahocorasick``), each of at most ``max_bytes`` of keywords, so the
size of what is shipped to the tasks is bounded; a larger table gives several automata and as many passes, whose matches
are merged, and the driver never holds more than one of them at a time. Every task then finds all rules of a text in
one scan of it, whatever their number, instead of one ``CASE`` branch per rule.

NULL texts match nothing; rules with a NULL or empty keyword never match; several rules may share a keyword; a rule id
that repeats counts once. Other columns pass through; columns named like the outputs are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.rules import require


def _automata(rules: DataFrame, max_bytes: int) -> Iterator[bytes]:
    """Pickled automata over the rules in ``rule_id`` order, each of at most ``max_bytes`` of keywords (one longer
    keyword makes one of its own). The rules are streamed to the driver a partition at a time."""
    import ahocorasick

    usable = rules.where(F.length("keyword") > 0).select("rule_id", "keyword", "category").orderBy("rule_id")
    machine, size, entries = ahocorasick.Automaton(), 0, {}

    def done():
        for keyword, found in entries.items():
            machine.add_word(keyword, tuple(found))
        machine.make_automaton()
        return pickle.dumps(machine)

    for row in usable.toLocalIterator(prefetchPartitions=True):
        keyword = row["keyword"].lower()
        cost = len(keyword.encode()) + 16
        if entries and size + cost > max_bytes:
            yield done()
            machine, size, entries = ahocorasick.Automaton(), 0, {}
        entries.setdefault(keyword, []).append((row["rule_id"], row["category"]))
        size += cost
    if entries:
        yield done()


_MATCH = T.StructType([T.StructField("ids", T.ArrayType(T.LongType(), False), False), T.StructField("first", T.StringType(), True)])


def _pass(df: DataFrame, text: str, machine: bytes, out: str) -> DataFrame:
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(machine)
    schema = T.StructType([*df.schema.fields, T.StructField(out, _MATCH, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(shipped.value)
        for batch in batches:
            ids, firsts = [], []
            for value in batch.column(text).to_pylist():
                found: dict[int, str] = {}
                if value:
                    for _, rules in automaton.iter(value.lower()):
                        for rule_id, category in rules:
                            found.setdefault(rule_id, category)
                order = sorted(found)
                ids.append(order)
                firsts.append(found[order[0]] if order else None)
            match = pa.StructArray.from_arrays(
                [pa.array(ids, pa.list_(pa.field("element", pa.int64(), False))), pa.array(firsts, pa.string())], fields=[pa.field("ids", pa.list_(pa.field("element", pa.int64(), False)), False), pa.field("first", pa.string())]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, match], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def keyword_matches(df: DataFrame, rules: DataFrame, text: str = "message", column: str = "rules", first: str | None = "category", default: str | None = None, max_bytes: int = 64 << 20) -> DataFrame:
    """Add ``column``, the ascending distinct ids of all rules whose keyword ``text`` contains, and unless ``first``
    is None, ``first``: the category of the rule with the smallest id among them (``default`` if none)."""
    require(max_bytes > 0, "max_bytes must be positive")
    dropped = [c for c in df.columns if c not in {column, first}]
    out = df.select(*dropped)
    parts = []
    for i, machine in enumerate(_automata(rules, max_bytes)):
        out = _pass(out, text, machine, f"_keywords{i}")
        parts.append(f"_keywords{i}")
    if not parts:
        matched = F.array().cast("array<long>")
        best = F.lit(None).cast("string")
    else:
        matched = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(p + ".ids") for p in parts)))))
        # Automata hold ascending runs of ids, so the first one that matched holds the smallest.
        best = F.coalesce(*(F.col(p + ".first") for p in parts))
    columns = [*dropped, matched.alias(column)]
    if first is not None:
        columns.append(F.coalesce(best, F.lit(default)).alias(first))
    return out.select(*columns)


def classify_by_keywords(df: DataFrame, rules: DataFrame, text: str = "message", default: str = "uncategorized", column: str = "category", max_bytes: int = 64 << 20) -> DataFrame:
    """The category of the matching rule with the smallest id, else ``default`` (A4 with a table of rules)."""
    return keyword_matches(df, rules, text, "_rules", column, default, max_bytes).drop("_rules")
