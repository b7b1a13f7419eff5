"""Raw lines to canonical log rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.maps import empty_map
from logloom.functions.text import is_blank, strip
from logloom.schema import LOG_COLUMNS

# Fixed line format: an ISO timestamp ending in Z, white space, then the body. ``.`` and ``$`` stop at LF only.
LINE_PATTERN = r"(?Ud)^(\d{4}-\d{2}-\d{2}T[\d:.]+Z)[\s\x1c-\x1f]+(.+)$"
# Fixed format for level words in plain text lines.
LEVEL_WORD_PATTERN = r"(?i)\b(trace|debug|info|warn|warning|error|fatal|critical)\b"
_JSON_OPTIONS = {"allowSingleQuotes": "false"}


def _with_members(df: DataFrame) -> DataFrame:
    """Add ``_members``: those of the JSON object in ``_body`` as text, or NULL if it is not exactly one object.

    One projection per step, so that each is evaluated once per row. The last step is a generator that yields
    one row per row: Catalyst pushes filters on parsed columns no further than that. Through projections it
    would push them below the parse, and copy the parse into the filter for every column it mentions.
    """
    text = F.col("_text")
    looks_like = text.startswith("{") & text.endswith("}")
    # Read as the only element of an array: a bare object parse would ignore trailing text.
    wrapped = F.when(looks_like, F.concat(F.lit("["), text, F.lit("]")))
    parsed = F.from_json(wrapped, "array<map<string,string>>", _JSON_OPTIONS)
    steps = df.withColumn("_text", strip(F.col("_body"))).withColumn("_parsed", parsed)
    steps = steps.withColumn("_object", F.when(F.size("_parsed") == 1, F.col("_parsed")[0]))
    steps = steps.withColumn("_unique", _last_of_each_key(F.col("_object")))
    one = F.when(F.col("_unique").isNotNull(), F.array("_unique"))
    return steps.select(*df.columns, F.explode_outer(one).alias("_members"))


def _last_of_each_key(members: Column) -> Column:
    """A JSON object may repeat a key; the last value counts."""
    keys = F.map_keys(members)
    entries = F.map_entries(members)
    distinct = F.filter(entries, lambda e, i: ~F.exists(F.slice(keys, i + 2, F.size(keys)), lambda k: k == e["key"]))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(distinct)).otherwise(members)


def parse_logs(df: DataFrame, text_level: bool = False) -> DataFrame:
    """Parse ``(source, seq, raw)`` rows; blank lines are dropped.

    With ``text_level`` a plain line without a JSON level takes the first level word of its text.
    """
    first, second = (F.nullif(F.regexp_extract("raw", LINE_PATTERN, g), F.lit("")) for g in (1, 2))
    split = df.where(~is_blank(F.col("raw"))).select(
        "source", "seq", "raw", first.alias("timestamp"), F.coalesce(second, F.col("raw")).alias("_body")
    )
    members = _with_members(split)

    def has(key: str) -> Column:
        return F.map_contains_key("_members", F.lit(key))

    def get(key: str) -> Column:
        return F.element_at("_members", F.lit(key))

    is_json = F.col("_members").isNotNull()
    level = F.when(has("level"), get("level")).otherwise(get("severity"))
    if text_level:
        word = F.nullif(F.regexp_extract("_body", LEVEL_WORD_PATTERN, 1), F.lit(""))
        level = F.when(is_json, level).otherwise(word)
    message = F.when(has("msg"), get("msg")).when(has("message"), get("message")).otherwise(F.col("_body"))
    structured = F.coalesce("_members", empty_map())
    return members.select(
        "source",
        "seq",
        "raw",
        "timestamp",
        F.col("timestamp").try_cast("timestamp").alias("ts"),
        level.alias("level"),
        get("service").alias("service"),
        message.alias("message"),
        is_json.alias("is_json"),
        structured.alias("structured"),
        structured.alias("extra"),
    ).select(*LOG_COLUMNS)
