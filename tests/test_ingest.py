import os
import time

import pytest
from pyspark.sql import functions as F

from lexhaven.operators import report
from lexhaven.plans.ingest import ingest
from lexhaven.sources import manifest as manifests
from lexhaven.sources import runlog, store
from lexhaven.streaming.files import ingest_stream

TREE = {
    "a/One.gs": "package p.q\nclass One {\n  function f() { return 1 }\n}\n",
    "a/Two.gsx": "enhancement Two : One { property get Big() : String { return \"" + "x" * 2500 + "\" } }\n",
    "t/Page.gst": "<%@ params() %>\n<%= 1 %>\n",
    "t/Plain.gst": "no regions",
    "Empty.gs": "// nothing\n",
    "Broken.gs": "class Broken {\n  var x = 1\n",
}


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "Source"
    for name, text in TREE.items():
        write(root, name, text)
    return root


def outcomes(spark, target, session):
    log = runlog.read_log(spark, f"{target}/runlog").where(F.col("session_id") == session)
    return {r.relative_path: r for r in log.collect()}


def statuses(spark, target, session):
    return {name: r.status for name, r in outcomes(spark, target, session).items()}


def stored(spark, target):
    return store.read_store(spark, f"{target}/store").collect()


def test_runs(spark, tree, tmp_path):
    target = str(tmp_path / "t")
    result = ingest(spark, str(tree), target, session_id="1").first()
    # One: class and function; Two: a long enhancement and its property in pieces; Page: two regions.
    counts = {r.relative_path: r.chunk_count for r in outcomes(spark, target, "1").values()}
    assert counts == {"a/One.gs": 2, "a/Two.gsx": 6, "t/Page.gst": 2, "t/Plain.gst": 0, "Empty.gs": 0, "Broken.gs": None}
    assert (result.files_processed, result.files_skipped, result.chunks_created, result.errors) == (5, 0, 10, 1)
    took = {r.relative_path: r.duration_ms for r in outcomes(spark, target, "1").values()}
    assert min(took.values()) >= 1 and took["Broken.gs"] == 1 and result.seconds > 0
    broken = outcomes(spark, target, "1")["Broken.gs"]
    assert broken.status == "parse_error" and broken.line_number == 1 and broken.column_number == 1
    assert broken.error_details[0].type == "MISSING" and "(1 issue(s)" in broken.error_message
    rows = stored(spark, target)
    assert len(rows) == 10 and {r.module for r in rows} == {"source"}
    assert {r.package for r in rows if r.relative_path == "a/One.gs"} == {"p.q"}
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)

    # Files without chunks are not recorded, and are read again.
    assert manifests.read_manifest(spark, f"{target}/manifest").count() == 3
    ingest(spark, str(tree), target, session_id="2")
    assert statuses(spark, target, "2") == {
        "a/One.gs": "skipped", "a/Two.gsx": "skipped", "t/Page.gst": "skipped", "t/Plain.gst": "success",
        "Empty.gs": "success", "Broken.gs": "parse_error",
    }
    assert len(stored(spark, target)) == 10

    # An edit is found by content; the chunks of the earlier state stay with upsert.
    write(tree, "a/One.gs", "package p.q\nclass One {\n  function g() { return 2 }\n}\n")
    os.utime(tree / "a/One.gs", (1, 1))
    ingest(spark, str(tree), target, session_id="3")
    assert statuses(spark, target, "3")["a/One.gs"] == "success"
    assert len(stored(spark, target)) == 12

    # Replacing drops them, and deleted files.
    write(tree, "a/One.gs", "package p.q\nclass One {\n  function h() { return 3 }\n}\n")
    (tree / "t/Page.gst").unlink()
    ingest(spark, str(tree), target, session_id="4", replace=True)
    rows = stored(spark, target)
    assert {r.method_name for r in rows if r.relative_path == "a/One.gs"} == {None, "h"}
    assert not [r for r in rows if r.relative_path == "t/Page.gst"] and len(rows) == 8
    assert manifests.read_manifest(spark, f"{target}/manifest").count() == 2
    assert report.list_sessions(runlog.read_log(spark, f"{target}/runlog")).count() == 4


def test_modification_time_mode(spark, tree, tmp_path):
    target = str(tmp_path / "t")
    ingest(spark, str(tree), target, session_id="1", mode="mtime")
    assert len(stored(spark, target)) == 10
    # A changed text with an old time is not noticed, a new time is.
    write(tree, "a/One.gs", "class Other { }\n")
    os.utime(tree / "a/One.gs", (1, 1))
    later = time.time() + 100
    os.utime(tree / "a/Two.gsx", (later, later))
    ingest(spark, str(tree), target, session_id="2", mode="mtime")
    got = statuses(spark, target, "2")
    assert got["a/One.gs"] == "skipped" and got["a/Two.gsx"] == "success" and got["t/Page.gst"] == "skipped"
    assert len(stored(spark, target)) == 10
    ingest(spark, str(tree), target, session_id="3", mode="mtime")
    assert statuses(spark, target, "3")["a/Two.gsx"] == "skipped"


def test_failed_embedding_fails_its_files_only(spark, tree, tmp_path):
    def make():
        def fn(texts):
            if any("Big" in t for t in texts):
                raise RuntimeError("429 too many requests")
            return [[1.0] for _ in texts]

        return fn

    target = str(tmp_path / "t")
    result = ingest(spark, str(tree), target, session_id="1", make=make).first()
    got = outcomes(spark, target, "1")
    failed = {n for n, r in got.items() if r.status == "rate_limit"}
    assert "a/Two.gsx" in failed and got["a/Two.gsx"].error_message == "429 too many requests"
    assert result.errors == len(failed) + 1
    assert not [r for r in stored(spark, target) if r.relative_path in failed]
    paths = {r.path for r in manifests.read_manifest(spark, f"{target}/manifest").collect()}
    assert not [p for p in paths if any(p.endswith(f) for f in failed)]


def test_single_file(spark, tree, tmp_path):
    target = str(tmp_path / "t")
    ingest(spark, str(tree / "a/One.gs"), target, source_root=str(tree), session_id="1")
    rows = stored(spark, target)
    assert {(r.relative_path, r.module) for r in rows} == {("a/One.gs", "source")}


def test_units_and_sizes_are_arguments(spark, tree, tmp_path):
    target = str(tmp_path / "t")
    ingest(
        spark, str(tree), target, session_id="1", size=100, overlap=10, line_mode="exact",
        source_units=("class_declaration",), template_units=("directive",), module="own",
    )
    rows = stored(spark, target)
    assert {r.chunk_type for r in rows} == {"class", "template_directive"}
    assert max(len(r.content) for r in rows) <= 100 and {r.module for r in rows} == {"own"}


def test_stream_in_two_steps_equals_one_batch(spark, tree, tmp_path):
    late = (tree / "a/Two.gsx").read_text()
    (tree / "a/Two.gsx").unlink()
    path, mark = str(tmp_path / "store"), str(tmp_path / "mark")
    ingest_stream(spark, str(tree), path, mark).awaitTermination()
    first = store.read_store(spark, path).count()
    write(tree, "a/Two.gsx", late)
    ingest_stream(spark, str(tree), path, mark).awaitTermination()
    streamed = store.read_store(spark, path)
    assert (first, streamed.count()) == (4, 10)
    ingest(spark, str(tree), str(tmp_path / "t"), session_id="1")
    batch = store.read_store(spark, str(tmp_path / "t/store"))
    columns = [c for c in batch.columns if c != "version"]
    assert sorted(map(str, streamed.select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))
    # A replay from a new checkpoint changes nothing.
    ingest_stream(spark, str(tree), path, str(tmp_path / "mark2")).awaitTermination()
    assert store.read_store(spark, path).count() == 10


def test_each_file_has_a_duration_of_its_own(spark, tmp_path):
    """A slow file is told from quick ones, and the session from its files."""
    root, target = tmp_path / "Source", str(tmp_path / "t")
    for name, body in (("Slow", "slow"), ("Quick", "quick"), ("Other", "quick")):
        write(root, f"{name}.gs", f"package a\nclass {name} {{\n  function f() {{ {body}() }}\n}}\n")

    def make():
        def run(texts):
            time.sleep(0.6 * sum("slow()" in t for t in texts))
            return [[1.0, 2.0] for _ in texts]

        return run

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        result = ingest(spark, str(root), target, session_id="1", make=make).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = outcomes(spark, target, "1")
    took = {name: r.duration_ms for name, r in rows.items()}
    assert took["Slow.gs"] >= 600 and len(set(took.values())) > 1
    # Each piece is timed from when it or the one before came, so no file's time is the whole run's.
    assert max(took.values()) < 1000 * result.seconds
    again = ingest(spark, str(root), target, session_id="2", make=make).first()
    assert again.files_skipped == 3 and {r.duration_ms for r in outcomes(spark, target, "2").values()} == {0}


def test_walk_by_time_opens_what_is_new_alone_and_writes_pieces_once(spark, tree, tmp_path, monkeypatch):
    # Contents of all files were shuffled to be matched with their names, and pieces lay on disk twice.
    from lexhaven.sources import files, tables

    opened, aside, plans = [], [], []
    read, place = files.read_walked, tables._place

    def read_walked(wanted, *options):
        opened.append(sorted(r.path for r in wanted.collect()))
        found = read(wanted, *options)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(files, "read_walked", read_walked)
    monkeypatch.setattr(tables, "_place", lambda s, staged, *rest: aside.append(staged) or place(s, staged, *rest))
    target = str(tmp_path / "t")
    ingest(spark, str(tree), target, session_id="1", mode="mtime", list_hidden=True)
    # First the new files, then those without pieces that may be broken.
    assert opened[0] == sorted(str(tree / n) for n in TREE) and opened[1] == [str(tree / "Broken.gs"), str(tree / "Empty.gs")]
    assert all("MapInArrow" in p and "Join" not in p and p.count("Exchange") == 1 for p in plans)
    assert [p for p in aside if "/store/aside-" in p] and not os.path.exists(next(p for p in aside if "/store/" in p))
    assert len(stored(spark, target)) == 10 and os.listdir(f"{target}/store") == ["gen=1"]
    listing = files.discover_files(spark, str(tree), list_hidden=True, content=False)
    assert listing.where("content is not null").isEmpty() and listing.where("length > 0").count() == 6

    opened.clear()
    later = time.time() + 100
    write(tree, "_late.gs", "class Late {}")
    os.utime(tree / "_late.gs", (later, later))
    ingest(spark, str(tree), target, session_id="2", mode="mtime", list_hidden=True)
    assert [str(tree / "_late.gs")] == [p for p in opened[0] if not p.endswith(("Empty.gs", "Broken.gs", "Plain.gst"))]
    assert statuses(spark, target, "2")["_late.gs"] == "success" and statuses(spark, target, "2")["a/One.gs"] == "skipped"
    assert len(stored(spark, target)) == 11
