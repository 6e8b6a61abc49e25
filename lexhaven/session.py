"""Spark sessions: settings, and the package on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings that suit the engine; a cluster's own are left alone where set.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    # Plans here have large expressions; noting the call site of each part is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_shipped: set[str] = set()


def ship_package(spark: SparkSession, package: str | None = None) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = package or os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lexhaven-ship-")
    archive = shutil.make_archive(
        os.path.join(folder, "lexhaven"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def local_session(cores: str = "*", memory: str = "8g", **settings: str) -> SparkSession:
    """A session on this machine, for tests and measurements."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lexhaven")
    builder = builder.config("spark.driver.memory", memory)
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": "8", **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark
