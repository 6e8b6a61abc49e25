"""The chunk store: a Parquet table of `STORE` rows, one per id.

Upserts add a version that holds only the incoming rows; readers leave out
rows of an older version whose id is in a newer one, and rows of a file that a
tombstone `(absolute_path, version)` declares gone before its version. `rewrite`
and `compact` write a whole new generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexhaven.functions.text import empty_to_null
from lexhaven.operators.upsert import latest_rows
from lexhaven.schemas import STORE, conform
from lexhaven.sources import tables
from lexhaven.sources.tables import is_folder

# Folder of the tombstones, beside the generations.
TOMBSTONES = "tombstones"
_TOMBSTONE = "absolute_path string, version long"

_METADATA = ("module", "package", "class_name", "enclosing_class", "method_name")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Current rows of a store, none where there is no store yet.

    Only the ids of versions after the first are read twice, and Spark
    broadcasts them while they are few, so the bulk of the store is neither
    shuffled nor sorted to be read.
    """
    _, found = tables.versions(spark, path)
    rows = tables.read_versions(spark, path, STORE)
    rows = rows.withColumns({c: empty_to_null(F.col(c)) for c in _METADATA})
    if is_folder(spark, f"{path}/{TOMBSTONES}"):
        gone = spark.read.schema(_TOMBSTONE).parquet(f"{path}/{TOMBSTONES}")
        gone = gone.groupBy(F.col("absolute_path").alias("gone_path")).agg(F.max("version").alias("gone_before"))
        dead = (F.col("absolute_path") == F.col("gone_path")) & (F.col("version") < F.col("gone_before"))
        rows = rows.join(gone, dead, "left_anti")
    if len(found) < 2:
        return rows
    newer = tables.read_versions(spark, path, STORE, found[1:])
    newest = newer.groupBy(F.col("id").alias("newer_id")).agg(F.max("version").alias("newest"))
    stale = (F.col("id") == F.col("newer_id")) & (F.col("version") < F.col("newest"))
    return rows.join(newest, stale, "left_anti")


def append_rows(rows: DataFrame, path: str, unique: bool = False) -> int:
    """Upsert rows by id: they become the newest version, and their ids' older rows stale.

    Rows known to be one per id are written where they are, without a shuffle.
    """
    rows = rows if unique else latest_rows(rows)
    return tables.write_version(conform(rows, STORE), path)


def replace_rows(rows: DataFrame, path: str, gone: DataFrame | None = None, unique: bool = False) -> int:
    """Put `rows` in place of all earlier rows of their files, and drop those of the files in `gone`.

    Writes only the rows and a tombstone for each file; `gone` has a column
    `path`. Tombstones are written last, so a writer lost in between leaves the
    earlier rows, and doing it again covers its own rows as well.
    """
    spark = rows.sparkSession
    version = append_rows(rows, path, unique)
    bury(spark, path, version, gone)
    return version


def bury(spark: SparkSession, path: str, version: int, gone: DataFrame | None = None) -> None:
    """Write tombstones of a version: for each file it has rows of, and for each `path` of `gone`."""
    files = tables.read_versions(spark, path, STORE, [version]).select("absolute_path")
    if gone is not None:
        files = files.unionByName(gone.select(F.col("path").alias("absolute_path")))
    files.distinct().withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(f"{path}/{TOMBSTONES}")


def stage_rows(rows: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Rows written within the store's folder, one per id, and the folder `tables.adopt` can make a version of.

    Columns that a store does not have stay beside its own; readers of the store pass over them.
    """
    own = STORE.fieldNames()
    whole = T.StructType(STORE.fields + [f for f in rows.schema.fields if f.name not in own])
    return tables.write_aside(conform(rows, whole), path)


def rewrite(rows: DataFrame, path: str) -> int:
    """Make `rows`, which may read the store, the store's whole content; tombstones are folded in.

    The new generation's version is above every tombstone's, so these say nothing about it.
    """
    version = tables.write_generation(conform(rows, STORE), path)
    tables.drop_folder(rows.sparkSession, f"{path}/{TOMBSTONES}")
    return version


def compact(
    spark: SparkSession, path: str, cluster_by=("language", "chunk_type", "package")
) -> int:
    """Merge all versions into one, rows of equal metadata next to each other.

    Parquet's statistics then skip row groups for filtered searches. The id
    ends the sort key, so that a large group is spread over many files.
    """
    rows = read_store(spark, path)
    keys = [*cluster_by, "id"]
    return rewrite(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), path)


def peek(store: DataFrame, n: int = 3) -> DataFrame:
    """A few rows: type, class, path and the first 60 characters."""
    return store.limit(n).select(
        "id", "chunk_type", "class_name", "relative_path",
        F.substring("content", 1, 60).alias("head"),
    )


def inspect(spark: SparkSession, stores: dict[str, str], n: int = 3) -> DataFrame:
    """One row per store, by name: its row count and a few sample rows."""

    def one(name: str, path: str) -> DataFrame:
        store = read_store(spark, path)
        sample = peek(store, n).agg(F.collect_list(F.struct("*")).alias("sample"))
        count = store.agg(F.count(F.lit(1)).alias("rows"))
        both = count.withColumn("_k", F.lit(1)).join(sample.withColumn("_k", F.lit(1)), "_k")
        return both.select(F.lit(name).alias("name"), "rows", "sample")

    return reduce(DataFrame.unionByName, [one(n_, p) for n_, p in stores.items()])
