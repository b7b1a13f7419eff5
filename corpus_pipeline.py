"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Models
are fitted on the labelled rows of the documents table in ``sf_dir``, so a stage judges alike whatever came before it.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.checkpoints import materialize
from logloom.llm import boosting, classifier, jaccard, keys, mixing, packing
from logloom.llm.texts import WORD

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is at least one half; null and empty texts are scored, too."""
    model = classifier.fit_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return docs.where(classifier.quality_score(model, F.col("text")) >= 0.5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the counted limits and the trees keep; null and empty texts fail."""
    forest = boosting.fit_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return docs.where(boosting.judge(F.col("text").cast("string"), forest)["kept"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group: 0.8 or more of the five-word shingles in common, directly or
    through others. Rows that share an id and a text are one document. Rows without an id come last in their group; those
    that also have no words stay.

    The verdict is per row, by a 64-bit key of id and text that no two different rows share."""
    blank = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(WORD)
    digested = docs.where(~blank).withColumn("__digest", keys.row_digest(F.col("doc_id"), F.col("text")))
    keyed = keys.with_unique_keys(digested, "__digest", "__key").drop("__digest")
    rows = keyed.select("__key", "doc_id", "text")
    groups = jaccard.similarity_components(rows, width=5, percent=80, id_column="__key").select(F.col("doc_id").alias("__key"), "component_id")
    named = materialize(groups.unionByName(rows.select("__key", "doc_id", F.lit(1).alias("one")), allowMissingColumns=True), "stage-groups")
    per_key = named.groupBy("__key").agg(F.max("component_id").alias("group"), F.max("doc_id").alias("doc_id"), F.count("one").alias("rows"))
    first = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "__key", "rows")).alias("first")
    kept = materialize(per_key.groupBy("group").agg(first).select(F.col("first.__key").alias("__kept"), F.col("first.rows").alias("__rows")), "stage-kept")
    same = F.col("__key") == F.col("__kept")
    # The texts are shuffled at any size, and once; rows that repeat are few.
    single = keyed.join(kept.where("__rows = 1").hint("merge"), same, "left_semi")
    repeated = keyed.join(materialize(kept.where("__rows > 1"), "stage-repeated"), same, "left_semi").dropDuplicates(["__key"])
    return single.unionByName(repeated).drop("__key").unionByName(docs.where(blank))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows that share an id, or have none, are told apart by their size."""
    mixed = materialize(mixing.mix_sources(docs).select(F.col("doc_id").alias("__id"), "size", F.col("times").cast("int").alias("__times")), "stage-mix")
    per_id = mixed.groupBy("__id").agg(F.count("*").alias("rows"), F.max("__times").alias("__times"))
    alone = (F.col("rows") == 1) & F.col("__id").isNotNull()
    single = docs.join(per_id.where(alone & (F.col("__times") > 0)).select("__id", "__times").hint("merge"), F.col("doc_id") == F.col("__id"))
    shared = materialize(per_id.where(~alone).select("__id"), "stage-repeated")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    rows = docs.join(shared, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    numbered = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(size)))
    times = mixed.join(shared.withColumnRenamed("__id", "__s"), F.col("__id").eqNullSafe(F.col("__s")), "left_semi")
    times = times.withColumn("__n", F.row_number().over(Window.partitionBy("__id").orderBy("size")))
    times = times.where("__times > 0").select("__id", "__n", "__times")
    matched = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__nth") == F.col("__n"))
    repeated = numbered.join(times, matched)
    columns = [*docs.columns, "__times"]
    both = single.select(*columns).unionByName(repeated.select(*columns))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.best_fit_pack(docs, TOKENIZER, capacity=2048, end_id=0, special_tokens=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]
#: SQL cannot express the models, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
