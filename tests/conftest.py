import pytest
from pyspark.sql import SparkSession

from logloom.schema import LOG_COLUMNS, LOG_SCHEMA


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("logloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def logs(spark):
    """Build log rows from dicts; seq defaults to the position, extra and structured to empty maps."""
    from datetime import datetime, timezone

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            base = dict(source="c", seq=i, structured={}, extra={}, is_json=False, message="")
            base.update(row)
            if base.get("timestamp") and "ts" not in row:
                parsed = datetime.fromisoformat(base["timestamp"].replace("Z", "+00:00"))
                base["ts"] = parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)
            full.append(tuple(base.get(c) for c in LOG_COLUMNS))
        return spark.createDataFrame(full, LOG_SCHEMA)

    return build


@pytest.fixture(scope="session")
def lines(spark):
    """Build raw lines of one source."""

    def build(raws, source="c"):
        return spark.createDataFrame([(source, i, r) for i, r in enumerate(raws)], "source string, seq long, raw string")

    return build
