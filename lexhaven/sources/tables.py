"""Parquet tables written as whole generations, never over what is being read.

A table's folder holds `gen=<n>/version=<m>` folders, each the output of one
Spark write, and a marker of this module's own beside each that was finished,
so nothing rests on the markers of Spark's committer. A write goes to a folder
with a name of its own first and takes its number only when done, by making a
file that must not exist yet; two writers so never get the same one. Readers
take the newest generation with a finished version.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Splits of input up to which a table counts as small.
SMALL_SPLITS = 8

# Codec of the tables: ids and hashes are hexadecimal digits, which Snappy does not make shorter.
CODEC = "zstd"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def is_folder(spark: SparkSession, path: str) -> bool:
    """True for an existing folder, on any file system Spark reads."""
    _, fs, where = _file_system(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def exists(spark: SparkSession, path: str) -> bool:
    """True for an existing file or folder."""
    _, fs, where = _file_system(spark, path)
    return fs.exists(where)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, by one call; none where there is no folder."""
    _, fs, where = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _numbers(names: list[str], prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def versions(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """Newest generation with finished versions, and these; `(0, [])` if none."""
    for gen in reversed(_numbers(_names(spark, path), "gen=")):
        if done := _numbers(_names(spark, f"{path}/gen={gen}"), "_done-"):
            return gen, done
    return 0, []


def _claim(spark: SparkSession, path: str, prefix: str, number: int) -> int:
    """The first free number from `number` on, taken by this writer alone."""
    hadoop, fs, where = _file_system(spark, path)
    fs.mkdirs(where)
    while not fs.createNewFile(hadoop.Path(path, f"{prefix}{number}")):
        number += 1
    return number


def _write(df: DataFrame, path: str, gen: int, version: int) -> int:
    """Write a version under a free number from `version` on, then say that it is done."""
    staged = f"{path}/gen={gen}/_new-{uuid.uuid4().hex}"
    df.drop("version").write.option("compression", CODEC).parquet(staged)
    return _place(df.sparkSession, staged, path, gen, version)


def _place(spark: SparkSession, staged: str, path: str, gen: int, version: int) -> int:
    """Move a finished folder to a free number from `version` on, then say that it is done."""
    folder = f"{path}/gen={gen}"
    version = _claim(spark, folder, "_taken-", version)
    hadoop, fs, _ = _file_system(spark, path)
    if not fs.rename(hadoop.Path(staged), hadoop.Path(f"{folder}/version={version}")):
        raise OSError(f"could not put version {version} of {path} in place")
    fs.createNewFile(hadoop.Path(folder, f"_done-{version}"))
    return version


def read_versions(
    spark: SparkSession, path: str, schema: T.StructType, wanted: list[int] | None = None
) -> DataFrame:
    """Rows of the newest generation with their `version`; empty when there is none."""
    gen, found = versions(spark, path)
    found = found if wanted is None else [v for v in found if v in wanted]
    fields = [f for f in schema.fields if f.name != "version"]
    schema = T.StructType(fields + [T.StructField("version", T.LongType(), True)])
    if not found:
        return spark.createDataFrame([], schema)
    folder = f"{path}/gen={gen}"
    return (
        spark.read.schema(schema)
        .option("basePath", folder)
        .parquet(*[f"{folder}/version={v}" for v in found])
    )


def write_version(df: DataFrame, path: str) -> int:
    """Add a version to the newest generation."""
    gen, found = versions(df.sparkSession, path)
    return _write(df, path, max(gen, 1), found[-1] + 1 if found else 1)


def write_aside(df: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Rows written within the folder of a table and not yet part of it, and the folder that holds them."""
    aside = f"{path}/aside-{uuid.uuid4().hex}"
    return written(df.drop("version"), aside), aside


def adopt(spark: SparkSession, aside: str, path: str) -> tuple[int, str]:
    """Make a folder of `write_aside` a version of the newest generation, by a move; the version and its folder."""
    gen, found = versions(spark, path)
    version = _place(spark, aside, path, max(gen, 1), found[-1] + 1 if found else 1)
    return version, f"{path}/gen={max(gen, 1)}/version={version}"


def write_generation(df: DataFrame, path: str, keep: int = 2) -> int:
    """Write a table that replaces the current one; `df` may read the current one.

    Of older generations the newest `keep - 1` stay, for readers that still use them.
    """
    spark = df.sparkSession
    gen, found = versions(spark, path)
    new = _claim(spark, path, "_gen-", gen + 1)
    version = _write(df, path, new, found[-1] + 1 if found else 1)
    for old in _numbers(_names(spark, path), "gen="):
        if old <= new - keep:
            drop_folder(spark, f"{path}/gen={old}")
    return version


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables that nothing reads any more."""
    _, fs, where = _file_system(spark, path)
    fs.delete(where, True)


def written(df: DataFrame, path: str, sort_by: list[str] | None = None) -> DataFrame:
    """Write an intermediate table and read it back; `sort_by` lays it out in ranges, sorted within."""
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Even out a small input over the cores; a large one stays as it is read.

    A small Parquet file is often one row group and so one task, which starves
    costly row-wise work. The input's size is known from its files; only what
    is no more than a few splits is shuffled for this, on any number of cores.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if int(str(size)) < min(cores, SMALL_SPLITS) * split else df


def shared_folder(spark: SparkSession, beside: str | None = None) -> str:
    """A new folder all executors reach, for intermediate tables.

    The cluster names it in `spark.checkpoint.dir`, or by the context's
    checkpoint folder; else it is made beside a table that is written anyway.
    Only a session on one machine may go without, as in tests; elsewhere that
    is an error, since each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or beside
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.gettempdir()
    # One folder per call, so that runs do not meet.
    return f"{named.rstrip('/')}/lexhaven-{uuid.uuid4().hex}"
