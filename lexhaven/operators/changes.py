"""Which files are new, changed, unchanged or deleted since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect_changes(
    files: DataFrame, manifest: DataFrame, mode: str = "hash", keep: tuple = ()
) -> DataFrame:
    """`path, status` for every path in the files or the manifest, and columns to `keep` of the files.

    `mode="hash"` compares `file_hash`, and so must read the files;
    `mode="mtime"` needs only their listing and takes a file as changed when it
    is newer than recorded, whatever its content.
    """
    if mode not in ("hash", "mtime"):
        raise ValueError(f"unknown mode {mode!r}")
    state = "file_hash" if mode == "hash" else "modification_time"
    now = files.select("path", F.col(state).alias("now"), F.lit(True).alias("present"), *keep)
    then = manifest.select("path", F.col(state).alias("then"), F.lit(True).alias("known"))
    differs = (
        ~F.col("now").eqNullSafe(F.col("then")) if mode == "hash" else F.col("now") > F.col("then")
    )
    status = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("present").isNull(), "deleted")
        .when(differs, "changed")
        .otherwise("unchanged")
    )
    return now.join(then, "path", "full_outer").select(
        "path", status.alias("status"), *keep
    )


def update_manifest(
    manifest: DataFrame,
    files: DataFrame,
    counts: DataFrame,
    record_empty: bool = False,
    deleted: DataFrame | None = None,
) -> DataFrame:
    """Manifest after a run over `files`, whose chunk counts are in `counts`.

    Files without chunks are not recorded, and so are read again next time,
    unless `record_empty`. Rows of other files stay, apart from `deleted`.
    """
    done = files.select("path", "file_hash", "modification_time").join(counts.select("path", "chunk_count"), "path", "left")
    done = done.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("bigint"))
    if not record_empty:
        done = done.where("chunk_count > 0")
    kept = manifest.join(done.select("path"), "path", "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select("path"), "path", "left_anti")
    return kept.unionByName(done)
