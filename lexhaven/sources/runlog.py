"""The run log on disk, partitioned by session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhaven.operators.report import files_with_errors, parse_errors, report_lines, session_rows
from lexhaven.schemas import RUNLOG, STATUSES, checked, conform
from lexhaven.sources import tables
from lexhaven.sources.trees import write_tree


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; a session's rows are read alone when it is filtered by session."""
    if not tables.exists(spark, path):
        return spark.createDataFrame([], RUNLOG)
    return spark.read.schema(RUNLOG).parquet(path).select(*RUNLOG.fieldNames())


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows; a status outside the closed set fails the write."""
    out = conform(rows, RUNLOG).withColumn("status", checked(F.col("status"), STATUSES, "status"))
    out.write.mode("append").partitionBy("session_id").parquet(path)


def write_session(rows: DataFrame, path: str) -> None:
    """Write whole sessions; one that is there already, as of a run that is done again, is replaced."""
    out = conform(rows, RUNLOG).withColumn("status", checked(F.col("status"), STATUSES, "status"))
    (
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("session_id").parquet(path)
    )


def export_session(log: DataFrame, path: str, session_id: str | None = None) -> None:
    """Write one session, by default the latest, as JSON lines: its summary, then its rows."""
    lines = report_lines(session_rows(log, session_id))
    ordered = lines.orderBy("section", "ts").select(F.col("json").alias("value"))
    ordered.write.mode("errorifexists").text(path)


def write_error_tree(files: DataFrame, log: DataFrame, path: str, session_id: str | None = None) -> None:
    """Write the files that had parse errors as files, below `path` as they lay below their root."""
    failed = parse_errors(log, session_id).select(F.col("file_path").alias("path"))
    write_tree(files_with_errors(files, failed), path)


def write_error_files(
    files: DataFrame, log: DataFrame, path: str, session_id: str | None = None
) -> None:
    """Write the files that had parse errors, in folders as their relative paths."""
    failed = parse_errors(log, session_id).select(F.col("file_path").alias("path"))
    folder = F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1)
    (
        files_with_errors(files, failed).withColumn("folder", folder)
        .write.mode("errorifexists").partitionBy("folder").parquet(path)
    )
