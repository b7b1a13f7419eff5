"""A prefix trie of conversations, built by collapsing whole sequences first.

Identical conversations are grouped into one *weighted sequence* (weight: how many, the smallest member, the sorted list
of members as the ends of its last node). Each sequence then names its prefixes by a chain of SHA-256 keys (a node is
the set of sequences that share its key), and nodes are sums over the rows of their prefixes: members, smallest member,
ends. A sequence that is a proper prefix of another has children; leaves are found by an anti-join of nodes against the
parents named by others. Subtree sums (leaves, saved tokens) are carried to every ancestor once: each node is *owned*
by the smallest sequence through it, and each sequence adds the values of the nodes it owns, summed from the bottom of
its path up, to every prefix on that path; grouping by prefix then gives each node the sum over its subtree.

Spark does the work as joins and groupings: turns are numbered per conversation, digests are aggregated per
conversation and per distinct sequence, prefix keys are made by Arrow batches one sequence at a time, and all node sums
are partial aggregates, so the root (a prefix of every sequence) or a very common first turn are summed per task before
any shuffle. A single conversation, and the member list of one distinct sequence, are held in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.texts import WORD

_ROOT = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """An injective digest of a turn: the role's length, the role, then the text."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def weighted_sequences(turns: DataFrame, conv: str = "conv", pos: str = "pos", digest: str = "digest", words: str = "words", members: DataFrame | None = None) -> DataFrame:
    """Group identical conversations: (seq, digests, words, weight, first, ends_sha256).

    ``turns`` holds one row per turn; ``members`` (column ``conv``), if given, adds conversations without turns.
    ``seq`` names a sequence; ``ends_sha256`` digests its members, ascending, comma-joined.
    """
    ordered = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(pos, digest, words))).alias("t"))
    if members is not None:
        ordered = members.select(conv).distinct().join(ordered, conv, "left")
    convs = ordered.select(
        conv,
        F.coalesce(F.col("t." + digest), F.array().cast("array<string>")).alias("digests"),
        F.coalesce(F.col("t." + words), F.array().cast("array<long>")).alias("words"),
    ).withColumn("seq", F.sha2(F.array_join("digests", ","), 256))
    return convs.groupBy("seq").agg(
        F.first("digests").alias("digests"),
        F.first("words").alias("words"),
        F.count("*").alias("weight"),
        F.min(conv).alias("first"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(conv)), ","), 256).alias("ends_sha256"),
    )


_PATH = T.StructType(
    [
        T.StructField("seq", T.StringType()),
        T.StructField("depth", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("words", T.LongType()),
        T.StructField("weight", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("ends_sha256", T.StringType()),
    ]
)


def _paths(sequences: DataFrame) -> DataFrame:
    """One row per (sequence, depth 0..length): its prefix key, parent key, last turn's words; ends at full length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {f.name: [] for f in _PATH.fields}
            for s, digests, words, weight, first, ends in zip(*(batch.column(c).to_pylist() for c in ("seq", "digests", "words", "weight", "first", "ends_sha256"))):
                key, parent = _ROOT, None
                for d in range(len(digests) + 1):
                    if d:
                        parent, key = key, hashlib.sha256((key + digests[d - 1]).encode()).hexdigest()
                    for name, value in zip(out, (s, d, key, parent, words[d - 1] if d else 0, weight, first, ends if d == len(digests) else None)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in _PATH.fields]))

    return sequences.select("seq", "digests", "words", "weight", "first", "ends_sha256").mapInArrow(run, _PATH)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of ``weighted_sequences``: key, parent, depth, conv_id (smallest member), n_convs, n_children,
    n_leaves and saved_tokens (over the subtree: (n_convs - 1) times the words of the node's last turn), ends_sha256
    (of members ending there; none: the empty string's digest), parent_conv_id."""
    paths = _paths(sequences)
    nodes = paths.groupBy("key").agg(
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.first("words").alias("words"),
        F.sum("weight").alias("n_convs"),
        F.min("first").alias("conv_id"),
        F.min("seq").alias("owner"),
        F.coalesce(F.max("ends_sha256"), F.lit(_ROOT)).alias("ends_sha256"),
    )
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    leaves = nodes.join(children, "key", "left_anti").select("key", F.lit(1).alias("leaf"))
    valued = nodes.join(children, "key", "left").join(leaves, "key", "left").select(
        "key", "owner", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("own"),
    )
    # Each node's values ride on the one sequence that owns it; running sums from the bottom of a path reach every
    # ancestor on it, and no node is counted twice.
    owned = paths.select("seq", "depth", "key").join(valued.select("key", "owner", "leaf", "own"), "key")
    owned = owned.select("seq", "depth", "key", *(F.when(F.col("owner") == F.col("seq"), F.col(c)).otherwise(0).alias(c) for c in ("leaf", "own")))
    below = Window.partitionBy("seq").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    subtree = owned.select("key", F.sum("leaf").over(below).alias("leaf"), F.sum("own").over(below).alias("own")).groupBy("key").agg(
        F.sum("leaf").alias("n_leaves"), F.sum("own").alias("saved_tokens")
    )
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(valued.select("key", "n_children"), "key")
        .join(subtree, "key")
        .join(parents, "parent", "left")
        .select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    )


def rebuilt_turns(conversations: DataFrame, donor_every: int = 20, donor_turns: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuild every conversation c: the first h turns of conversation c - c % ``donor_every`` (SQL remainder; all of
    them if fewer, none if absent), then c's own turns after its first h; h = crc32(decimal c) % ``donor_turns``.

    Turns are ordered by ``turn`` (NULL first), then role and text; NULL role or text reads as empty. Rows without a
    conv_id belong to no conversation and are left out. Returns (turns: conv, pos, digest, words; conversations: conv).
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    numbered = rows.select(
        "conv_id",
        (F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1).alias("k"),
        turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )
    lengths = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = lengths.select(
        F.col("conv_id").alias("conv"),
        (F.col("conv_id") - F.col("conv_id") % donor_every).alias("donor"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % donor_turns).alias("h"),
    )
    donors = convs.join(lengths.withColumnRenamed("conv_id", "donor"), "donor", "left").select("conv", "donor", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("m"))
    # Each donor lends to at most ``donor_every`` conversations, so this join cannot fan out further.
    lent = donors.join(numbered.withColumnRenamed("conv_id", "donor"), "donor").where(F.col("k") < F.col("h")).select("conv", F.col("k").alias("pos"), "digest", "words")
    own = donors.join(numbered.withColumnRenamed("conv_id", "conv"), "conv").where(F.col("k") >= F.col("h"))
    own = own.select("conv", (F.col("m") + F.col("k") - F.col("h")).alias("pos"), "digest", "words")
    return lent.unionByName(own), convs.select("conv")
