"""The manifest: what was ingested, from which file state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexhaven.schemas import MANIFEST, conform
from lexhaven.sources import tables


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Current manifest, empty before the first run."""
    return tables.read_versions(spark, path, MANIFEST).drop("version")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Replace the manifest; the rows may come from the current one."""
    tables.write_generation(conform(manifest, MANIFEST), path)
