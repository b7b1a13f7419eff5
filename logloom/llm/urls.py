"""URL verdicts: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter's blocks are 512 bits, one bit in each of eight 64-bit words per key. It is built by a grouped bitwise or,
has at most ``max_blocks`` blocks (16 MB by default, whatever the list's length) and only saves work: what passes it is
joined exactly with the list, so false positives change nothing.

Rows: a url that is null or has no ``://`` has an empty host and path and fits no rule and no list entry. Repeated rows
are judged each. Empty tables and an empty list are allowed; extra columns are not read.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.checkpoints import materialize
from logloom.workers import ship_package


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    host: str
    path: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), capitals, capitals.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Without scheme, ``www.``, default port, query, fragment and closing slashes; null without a host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"/+$", ""), F.lit("/")))


def matching_rule(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))
    none = F.lit(None).cast("string")
    name = F.coalesce(*(F.when(r.fits(host, path), F.lit(r.host + r.path)) for r in ordered), none)
    verdict = F.coalesce(*(F.when(r.fits(host, path), F.lit(r.verdict)) for r in ordered), none)
    return name, verdict


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def bloom_blocks(listed: DataFrame, max_blocks: int = 1 << 18, bits_per_key: int = 12) -> np.ndarray:
    """Blocks x 8 words of the filter over ``listed.canonical``."""
    blocks = 1
    while blocks < max_blocks and blocks * 512 < listed.count() * bits_per_key:
        blocks *= 2
    place, bits = _hashes(F.col("canonical"))

    def word(i):
        bit = F.shiftright(bits, 6 * i).bitwiseAND(63).cast("int")
        return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(f"w{i}")

    words = [word(i) for i in range(8)]
    # At most one row per block.
    rows = listed.groupBy(F.pmod(place, F.lit(blocks)).alias("block")).agg(*words).toArrow()
    table = np.zeros((blocks, 8), np.uint64)
    if rows.num_rows:
        at = rows.column("block").to_numpy()
        for i in range(8):
            table[at, i] = rows.column(f"w{i}").to_numpy().view(np.uint64)
    return table


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[UrlRule],
    id_column: str = "page_id",
    url_column: str = "url",
    listed_verdict: str = "block",
    default: str = "allow",
    max_blocks: int = 1 << 18,
) -> DataFrame:
    """``page_id, host, path, canonical, rule, listed, verdict``; ``listed`` has a column ``url``."""
    spark = pages.sparkSession
    ship_package(spark)
    h, p = host_and_path(F.col("url"))
    keys = listed.select(canonical(h, p).alias("canonical")).where(F.col("canonical").isNotNull()).distinct()
    entries = materialize(keys, "url-list")
    table = spark.sparkContext.broadcast(bloom_blocks(entries, max_blocks))

    @F.pandas_udf("boolean")
    def passes(place: pd.Series, bits: pd.Series) -> pd.Series:
        words = table.value
        at = place.to_numpy() % len(words)
        value = bits.to_numpy()
        hit = np.ones(len(at), bool)
        for i in range(8):
            hit &= (words[at, i] >> ((value >> (6 * i)) & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(hit)

    host, path = host_and_path(F.col(url_column))
    named = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    keyed = named.select("*", canonical(F.col("host"), F.col("path")).alias("canonical"), rule.alias("rule"), ruled.alias("ruled"))
    probed = materialize(keyed.withColumn("maybe", passes(*_hashes(F.col("canonical"))) & F.col("canonical").isNotNull()), "url-probed")
    hits = probed.where("maybe").join(entries.select("canonical", F.lit(True).alias("found")), "canonical", "left")
    both = probed.where("NOT maybe").withColumn("found", F.lit(None).cast("boolean")).unionByName(hits)
    in_list = F.coalesce("found", F.lit(False))
    verdict = F.coalesce("ruled", F.when(in_list, F.lit(listed_verdict)).otherwise(default))
    return both.select("page_id", "host", "path", "canonical", "rule", in_list.alias("listed"), verdict.alias("verdict"))
