"""Making this package importable in Python workers."""

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="logloom-package-")) / "logloom"
        context.addPyFile(shutil.make_archive(str(archive), "zip", package.parent, package.name))
    _shipped.add(context.applicationId)
