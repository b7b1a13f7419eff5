"""The canonical log record: one row per log line, identified by ``(source, seq)``."""

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

LOG_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        # Arrival order within the source. Unique per source; gaps are allowed.
        T.StructField("seq", T.LongType()),
        T.StructField("raw", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("is_json", T.BooleanType()),
        T.StructField("structured", STRING_MAP),
        T.StructField("extra", STRING_MAP),
    ]
)

LOG_COLUMNS = LOG_SCHEMA.fieldNames()

# The pair that names a row. Order-dependent operators decide on narrow rows and join back on it.
ROW_ID = ["source", "seq"]
