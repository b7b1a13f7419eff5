from pathlib import Path

from logloom.checkpoints import drop_scratch, materialize


def test_scratch_tables_last_until_dropped(spark):
    table = materialize(spark.range(5), "kept")
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert table.count() == 5 and any(folder.glob("kept-*"))
    drop_scratch(spark)
    assert folder.is_dir() and not any(folder.iterdir())
    assert materialize(spark.range(3), "again").count() == 3
