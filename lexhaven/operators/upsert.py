"""Upsert by id and replacement by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One row per key: the one with the highest `order`, else any.

    The rank limit runs before the shuffle too, so a key with very many rows
    sends one row per task.
    """
    by = F.col(order).desc() if order else F.lit(1)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(by))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(store: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Store rows whose id is not incoming, and the latest incoming row of each id."""
    fresh = latest_rows(incoming, "id", order)
    kept = store.join(fresh.select("id"), "id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def replace_files(
    store: DataFrame, chunks: DataFrame, deleted: DataFrame | None = None
) -> DataFrame:
    """Drop all rows of the incoming and the deleted files, then add the incoming rows.

    Unlike `upsert` it leaves no chunks of earlier states of a file behind.
    `deleted` holds the paths of files that are gone.
    """
    paths = chunks.select("absolute_path")
    if deleted is not None:
        paths = paths.unionByName(deleted.select(F.col("path").alias("absolute_path")))
    kept = store.join(paths.distinct(), "absolute_path", "left_anti")
    return kept.unionByName(chunks, allowMissingColumns=True)
