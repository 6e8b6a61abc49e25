import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lexhaven.operators import report
from lexhaven.schemas import RUNLOG, STATUSES
from lexhaven.sources import runlog


def moment(n):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=n)


def row(n, session, path, status, chunks=None, message=None, details=None):
    first = details[0] if details else None
    return (moment(n), session, "/r/" + path, path, status, chunks, message, details,
            first and first[1], first and first[2], 5)


@pytest.fixture(scope="module")
def log(spark):
    issue = ("MISSING", 3, 4, 5, 6, "class X {")
    rows = [row(n, "s1", f"{s}{n}.gs", s, 3 if s == "success" else None) for n, s in enumerate(STATUSES)]
    rows += [row(100 + n, "s2", f"e{n:03d}.gs", "unknown_error", None, "boom") for n in range(120)]
    rows += [row(300, "s2", "z.gs", "parse_error", None, "bad", [issue]), row(301, "s2", "a.gs", "parse_error", None, "bad", [issue])]
    rows += [row(302, "s2", "ok.gs", "success", 0), row(303, "s2", "sk.gs", "skipped")]
    return spark.createDataFrame(rows, RUNLOG)


def test_latest_session(log):
    assert [r.session_id for r in report.latest_session(log).collect()] == ["s2"]
    assert report.latest_session(log.limit(0)).count() == 0


def test_summary(log):
    got = {(r.session_id, r.status): (r.files, r.chunks) for r in report.session_summary(log).collect()}
    assert got[("s1", "success")] == (1, 3) and got[("s1", "skipped")] == (1, None)
    assert got[("s2", "unknown_error")] == (120, None) and got[("s2", "success")] == (1, 0)
    totals = {(r.session_id, r.status): (r.files, r.chunks) for r in report.summary_with_total(log).collect()}
    assert totals[("s1", "TOTAL")] == (9, 3) and totals[("s2", "TOTAL")] == (124, 0)
    assert totals[("s2", "unknown_error")] == (120, 0)


def test_errors(log):
    got = report.errors(log).collect()
    assert len(got) == 100
    assert [r.relative_path for r in got[:3]] == ["a.gs", "z.gs", "e119.gs"]
    assert {r.status for r in report.errors(log, "s1").collect()} == set(STATUSES) - {"success", "skipped"}


def test_parse_errors_and_rows(log):
    assert [r.relative_path for r in report.parse_errors(log).collect()] == ["a.gs", "z.gs"]
    assert [r.relative_path for r in report.session_log(log, "s1").limit(2).collect()] == ["success0.gs", "skipped1.gs"]
    assert {(r.session_id, r.rows) for r in report.list_sessions(log).collect()} == {("s1", 9), ("s2", 124)}


def test_run_result(log):
    got = {r.session_id: r for r in report.run_result(log).collect()}
    one = got["s1"]
    assert (one.files_processed, one.files_skipped, one.chunks_created, one.errors) == (1, 1, 3, 7)
    # The first file took 5 ms before its row was written.
    assert one.seconds == 8.005 and one.chunks_per_file == 3.0 and one.chunks_per_second == 3 / 8.005


def test_error_files(spark):
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    failed = spark.createDataFrame([("a",), ("a",), ("x",)], "path string")
    assert [tuple(r) for r in report.files_with_errors(files, failed).collect()] == [("a", 1)]


def test_on_disk(spark, log, tmp_path, plan_of):
    path = str(tmp_path / "log")
    assert runlog.read_log(spark, path).count() == 0
    runlog.append_log(log.where("session_id = 's1'"), path)
    runlog.append_log(log.where("session_id = 's2'"), path)
    back = runlog.read_log(spark, path)
    assert back.columns == RUNLOG.fieldNames()
    assert sorted(map(str, back.collect())) == sorted(map(str, log.collect()))
    assert "PartitionFilters: [isnotnull(session_id" in plan_of(report.session_rows(back, "s1"))
    bad = log.limit(1).withColumn("status", F.lit("fine"))
    with pytest.raises(Exception, match="unknown status"):
        runlog.append_log(bad, path)


def test_export(spark, log, tmp_path):
    runlog.export_session(log, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    lines = [json.loads(line) for part in parts for line in part.read_text().splitlines()]
    head, rows = lines[0], lines[1:]
    assert head["sessionId"] == "s2"
    assert {"status": "unknown_error", "count": 120} in head["summary"]
    assert {"status": "success", "count": 1, "total_chunks": 0} in head["summary"]
    assert len(rows) == 124 and [r["ts"] for r in rows] == sorted(r["ts"] for r in rows)
    assert rows[-3]["error_details"][0]["start_line"] == 3


def test_error_files_on_disk(spark, log, tmp_path):
    files = spark.createDataFrame([("/r/z.gs", "z.gs", "t"), ("/r/sub/q.gs", "sub/q.gs", "u")], "path string, relative_path string, text string")
    more = log.where("status = 'parse_error'").withColumn("file_path", F.lit("/r/sub/q.gs"))
    runlog.write_error_files(files, log.unionByName(more), str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert {(r.relative_path, r.folder) for r in back.collect()} == {("z.gs", None), ("sub/q.gs", "sub")}
