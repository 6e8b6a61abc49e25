"""Run-log summaries, listings and reports."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexhaven.functions.errors import error_status

# Outcomes that are no errors.
NO_ERROR = ("success", "skipped")

ERROR_LIMIT = 100


def latest_session(log: DataFrame) -> DataFrame:
    """Session of the newest row, as a table of one row, or none for an empty log."""
    return log.orderBy(F.col("ts").desc(), F.col("session_id").desc()).select("session_id").limit(1)


def session_rows(log: DataFrame, session_id: str | None = None) -> DataFrame:
    """Rows of one session, by default the latest."""
    if session_id is not None:
        return log.where(F.col("session_id") == session_id)
    # One row, so it can be sent to every task; it also prunes the partitions read.
    return log.join(F.broadcast(latest_session(log)), "session_id", "left_semi")


def session_summary(log: DataFrame) -> DataFrame:
    """Rows and chunks by session and status; chunks stay NULL where none were counted."""
    return log.groupBy("session_id", "status").agg(
        F.count(F.lit(1)).alias("files"), F.sum("chunk_count").alias("chunks")
    )


def summary_with_total(log: DataFrame) -> DataFrame:
    """The summary with a TOTAL row per session, and 0 where no chunks were counted."""
    totals = log.groupingSets(
        [["session_id", "status"], ["session_id"]], "session_id", "status"
    ).agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"),
        F.grouping("status").alias("_total"),
    )
    status = F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("status"))
    return totals.select("session_id", status.alias("status"), "files", "chunks")


def errors(log: DataFrame, session_id: str | None = None, limit: int = ERROR_LIMIT) -> DataFrame:
    """Newest errors of a session, at most `limit`."""
    rows = session_rows(log, session_id).where(~F.col("status").isin(*NO_ERROR))
    return rows.orderBy(F.col("ts").desc(), "file_path").limit(limit)


def parse_errors(log: DataFrame, session_id: str | None = None) -> DataFrame:
    """Parse errors of a session in the order of their files."""
    return session_rows(log, session_id).where("status = 'parse_error'").orderBy("file_path")


def session_log(log: DataFrame, session_id: str | None = None) -> DataFrame:
    """Rows of a session in the order of time."""
    return session_rows(log, session_id).orderBy("ts", "file_path")


def list_sessions(log: DataFrame) -> DataFrame:
    """Every session with its first and last time and its number of rows."""
    return log.groupBy("session_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("rows")
    )


def run_result(log: DataFrame, started: datetime.datetime | None = None) -> DataFrame:
    """One row per session: processed, skipped and failed files, chunks, duration, rates.

    A session lasts from `started`, where that is known, or else its first row or the begin of
    the earliest work that a row tells of, to its last row.
    """
    lasted = F.coalesce("duration_ms", F.lit(0)) if "duration_ms" in log.columns else F.lit(0)
    begin = F.unix_micros("ts") - 1000 * lasted
    earliest = F.min(begin)
    if started is not None:
        earliest = F.least(earliest, F.unix_micros(F.lit(started)))
    took = F.unix_micros(F.max("ts")) - earliest
    sums = log.groupBy("session_id").agg(
        F.count_if(F.col("status") == "success").alias("files_processed"),
        F.count_if(F.col("status") == "skipped").alias("files_skipped"),
        F.coalesce(
            F.sum(F.when(F.col("status") == "success", F.col("chunk_count"))), F.lit(0)
        ).alias("chunks_created"),
        F.count_if(~F.col("status").isin(*NO_ERROR)).alias("errors"),
        (took / 1e6).alias("seconds"),
    )
    return sums.withColumns(
        {
            "chunks_per_file": F.try_divide("chunks_created", "files_processed"),
            "chunks_per_second": F.try_divide("chunks_created", "seconds"),
        }
    )


def triage(rows: DataFrame, message: str = "error_message") -> DataFrame:
    """Add `status`, read from an error message."""
    return rows.withColumn("status", error_status(F.col(message)))


def files_with_errors(files: DataFrame, failed: DataFrame) -> DataFrame:
    """The files that occur in `failed`, each once, whatever the number of errors."""
    return files.join(failed.select("path"), "path", "left_semi")


def report_lines(log: DataFrame) -> DataFrame:
    """JSON report of every session: a line with its summary and time, then its rows in time order.

    `session_id, section, ts, json`. The statuses of a summary are few; rows
    stay one line each, so that no session has to fit into one task.
    """
    by_status = session_summary(log).withColumn(
        "line", F.struct("status", F.col("files").alias("count"), F.col("chunks").alias("total_chunks"))
    )
    heads = by_status.groupBy("session_id").agg(F.array_sort(F.collect_list("line")).alias("summary"))
    heads = heads.join(log.groupBy("session_id").agg(F.max("ts").alias("timestamp")), "session_id")
    head_json = F.to_json(F.struct(F.col("session_id").alias("sessionId"), "timestamp", "summary"))
    rows = log.select(
        "session_id", F.lit("log").alias("section"), "ts",
        F.to_json(F.struct(*log.columns)).alias("json"),
    )
    head = heads.select(
        "session_id", F.lit("head").alias("section"), F.lit(None).cast("timestamp").alias("ts"),
        head_json.alias("json"),
    )
    return head.unionByName(rows)
