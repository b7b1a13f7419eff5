"""Exact 64-bit keys of row contents, for operators that take long ids.

A key is the 64-bit hash of a 256-bit digest of the row's fields, so equal rows get equal keys without any shuffle of the
rows. Different digests that share a hash are found by one aggregate over (key, digest) pairs, which are small; only
their rows get new keys, drawn from further hashes of the digest until none is in use, and those few are joined back
through a broadcast table whose size is counted first. No two different rows share a key, and the texts are never
shuffled for it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.checkpoints import materialize

#: Digests whose key clashes that may be broadcast; beyond it the fix is a shuffle join of the rows.
BROADCAST_FIXES = 1 << 20


def row_digest(*fields: Column) -> Column:
    """SHA-256 (32 bytes) of the fields, NULL told from empty: each field as a flag, then its text; only the last may
    hold ``\\n``."""
    parts = []
    for f in fields:
        parts += [f.isNull().cast("string"), F.coalesce(f.cast("string"), F.lit(""))]
    return F.unhex(F.sha2(F.concat_ws("\n", *parts), 256))


def with_unique_keys(rows: DataFrame, digest: str, key: str, bits: int = 64) -> DataFrame:
    """``rows`` with ``key`` (long): equal for rows of equal ``digest`` and different for different ones. A column
    named ``key`` is replaced. ``bits`` narrows the first hash (tests use it to make clashes common)."""
    first = F.xxhash64(digest)
    hashed = rows.withColumn(key, first if bits >= 64 else first.bitwiseAND(F.lit((1 << bits) - 1)))
    pairs = materialize(hashed.select(key, digest).distinct(), "key-pairs")
    clashing = pairs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    pending = materialize(pairs.join(clashing, key, "left_semi").select(digest), "key-clashes")
    if pending.isEmpty():
        return hashed
    taken = pairs.select(key)
    fixed = None
    for seed in range(1, 64):
        candidates = pending.withColumn(key, F.xxhash64(digest, F.lit(seed)))
        alone = candidates.groupBy(key).agg(F.count("*").alias("n")).where("n = 1").select(key)
        # A new key must be met by no digest's first key and by no other candidate.
        free = candidates.join(alone, key, "left_semi").join(taken, key, "left_anti")
        free = materialize(free, "key-fixes")
        fixed = free if fixed is None else fixed.unionByName(free)
        taken = taken.unionByName(free.select(key))
        pending = materialize(pending.join(free, digest, "left_anti"), "key-clashes")
        if pending.isEmpty():
            break
    else:
        raise RuntimeError("no free key found in 63 further hashes")
    new = fixed.select(digest, F.col(key).alias("__new_key"))
    if new.count() <= BROADCAST_FIXES:
        new = F.broadcast(new)
    joined = hashed.join(new, digest, "left")
    return joined.withColumn(key, F.coalesce("__new_key", key)).drop("__new_key")
