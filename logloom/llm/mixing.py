"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source whose target is ``c + f`` times its size gives every document ``c`` whole copies; the share ``f`` is drawn.
Documents are ranked by random odds divided by inclusion odds, u / (1 - u) : preference * f / (1 - f), and the first
ones whose words fit the rest of the target are taken (a sample of fixed size in words). The one document not taken whose
size comes closest to the gap that remains is added if that brings the source nearer.

The rank is found without sorting a source: a 24-bit rank key is counted at two levels of 4,096 buckets, running sums
find the bucket in which the target falls, and only that bucket's documents are ordered. ``u`` comes from a hash of the id, so reruns agree.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.checkpoints import materialize
from logloom.llm.texts import WORD

#: The most often that a document may be taken.
CAP = 3
_LEVEL = 4096


def source_targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """``source, source_size, target, copies, share, rest`` of (source, size) rows.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes. A target stops at ``cap``
    times its source's size and the excess goes to the others by weight: the source fills at the level ``cap * size /
    weight``, so the common level is found from running sums over sources in that order. One row per source is ordered.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("place", F.row_number().over(by_name)).withColumn("weight", (F.col("place") - 1) % 3 + 1)
    fills = F.lit(float(cap)) * F.col("source_size") / F.col("weight")
    by_level = Window.orderBy("fills", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(by_level), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0))
    )
    levels = weighed.withColumn("fills", fills).withColumn("level", level)
    # The level that holds is the first one that its own source does not fill at.
    common = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "place", "level"))).over(everything)["level"]
    target = F.least(F.lit(float(cap)) * F.col("source_size"), F.col("weight") * common)
    ratio = F.col("target") / F.col("source_size")
    return (
        levels.withColumn("target", F.coalesce(target, F.lit(0.0)))
        .withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.floor(ratio), F.lit(cap))).otherwise(0).cast("long"))
        .withColumn("rest", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
        .withColumn("share", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
        .select("source", "source_size", "target", "copies", "rest", "share")
    )


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on ``key`` and ``seed`` only."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    preference: Column | None = None,
    seed: str = "mix",
    cap: int = CAP,
) -> DataFrame:
    """``doc_id, size, source_size, target, times, taken``: one row per document, ``times`` whole copies of it.

    Sizes are words; null and empty texts have size 0 and are taken with their source's whole copies only. Null is a
    source of its own, last. ``preference`` multiplies a document's inclusion odds (null or not positive counts as 1).
    Repeated rows are drawn each for itself; ties in rank go by id, then size. An empty table gives no rows.
    """
    wanted = F.coalesce(preference.cast("double"), F.lit(1.0)) if preference is not None else F.lit(1.0)
    size = F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    narrow = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        size.alias("size"),
        F.when(wanted > 0, wanted).otherwise(1.0).alias("preference"),
        uniform(F.col(id_column), seed).alias("u"),
        F.monotonically_increasing_id().alias("row"),  # kept by the write below; tells repeated rows apart
    )
    sizes = materialize(narrow, "mix-sizes")
    targets = materialize(source_targets(sizes, cap), "mix-targets")
    # Random odds over inclusion odds, squeezed into [0, 2^24) in the same order.
    odds = F.col("u") / (1 - F.col("u")) / F.col("preference") * (1 - F.col("share")) / F.greatest("share", F.lit(1e-12))
    rank = F.floor(odds / (1 + odds) * F.lit(_LEVEL * _LEVEL)).cast("long")
    ranked = (
        sizes.join(targets, sizes["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("odds", odds)
        .withColumn("rank", F.least(rank, F.lit(_LEVEL * _LEVEL - 1)))
        .withColumn("bucket", F.floor(F.col("rank") / _LEVEL))
    )

    def crossing(rows: DataFrame, keys: list[str], bucket: str, rest: str) -> DataFrame:
        """Per ``keys``: the bucket in which the running sum of sizes passes ``rest``, and the sum before it."""
        counted = rows.groupBy(*keys, bucket).agg(F.sum("size").alias("n"), F.max(rest).alias("limit"))
        ordered = Window.partitionBy(*keys).orderBy(bucket)
        running = counted.withColumn("before", F.sum("n").over(ordered) - F.col("n"))
        passed = running.where(F.col("before") + F.col("n") > F.col("limit"))
        return passed.groupBy(*keys).agg(F.min(F.struct(bucket, "before")).alias("at"))

    coarse = crossing(ranked, ["source"], "bucket", "rest").select(
        F.col("source").alias("s1"), F.col("at.bucket").alias("b1"), F.col("at.before").alias("before1")
    )
    inside = ranked.join(coarse, F.col("source").eqNullSafe(F.col("s1")) & (F.col("bucket") == F.col("b1"))).withColumn(
        "left", F.col("rest") - F.col("before1")
    )
    fine = crossing(inside, ["source"], "rank", "left").select(
        F.col("source").alias("s2"), F.col("at.rank").alias("r2"), F.col("at.before").alias("before2")
    )
    edge = inside.join(fine, F.col("source").eqNullSafe(F.col("s2")) & (F.col("rank") == F.col("r2"))).withColumn(
        "left", F.col("left") - F.col("before2")
    )
    # Documents of one rank key in 2^24 of one source.
    in_order = Window.partitionBy("source").orderBy("odds", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    fits = edge.withColumn("fits", F.sum("size").over(in_order) <= F.col("left"))
    last = fits.groupBy("source", "r2").agg(
        F.count_if("fits").alias("n_fit"), F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("fit"), F.max("left").alias("left")
    )
    # Without a crossing everything fits.
    cuts = materialize(
        last.select(F.col("source").alias("s3"), "r2", "n_fit", (F.col("left") - F.col("fit")).alias("gap")),
        "mix-cuts",
    )
    marked = ranked.join(cuts, F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")
    placed = Window.partitionBy("source").orderBy("odds", "doc_id", "size", "row")
    at_cut = marked.where(F.col("rank") == F.col("r2")).withColumn("drawn", F.row_number().over(placed) <= F.col("n_fit"))
    off_cut = marked.where(F.col("r2").isNull() | (F.col("rank") != F.col("r2"))).withColumn(
        "drawn", (F.col("share") > 0) & (F.col("r2").isNull() | (F.col("rank") < F.col("r2")))
    )
    drawn = materialize(
        at_cut.unionByName(off_cut).select(
            "row", "doc_id", "source", "size", "source_size", "target", "copies", "odds", "gap", F.coalesce("drawn", F.lit(False)).alias("drawn")
        ),
        "mix-drawn",
    )
    # One more document per source, where it closes the gap better than leaving it.
    nearest = F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "odds", "doc_id", "size", "row", "gap"))
    more = (
        drawn.where(~F.col("drawn") & (F.col("size") > 0) & (F.col("copies") < cap) & (F.col("gap") > 0))
        .groupBy("source")
        .agg(nearest.alias("best"))
        .where(F.col("best.miss") < F.col("best.gap"))
        .select(F.col("best.row").alias("row"), F.lit(True).alias("added"))
    )
    final = drawn.join(more, "row", "left")
    times = F.col("copies") + F.when(F.col("drawn") | F.col("added").isNotNull(), 1).otherwise(0)
    return final.select(
        "doc_id", "size", "source_size", "target", times.cast("long").alias("times"), (times * F.col("size")).cast("long").alias("taken")
    )
