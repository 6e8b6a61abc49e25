import datetime
import os

import pytest
from pyspark.sql import functions as F

from lexhaven.operators.embedding import hashed_words
from lexhaven.sources import manifest as manifests
from lexhaven.sources import runlog, store
from lexhaven.streaming import edits

DAY = datetime.datetime(2024, 5, 1)
CODE = "class {0} {{\n  function {1}() {{\n  }}\n}}\n"


@pytest.fixture()
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(key)
    spark.conf.set(key, edits.STATE_STORE)
    yield
    spark.conf.set(key, held)


def put(root, name, text, hour):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (1_700_000_000 + 3600 * hour,) * 2)


def test_tree_followed_through_listings(spark, tmp_path, state_store):
    tree, listings, target = tmp_path / "tree", str(tmp_path / "listings"), str(tmp_path / "target")

    def listed(hour):
        edits.append_listing(spark, str(tree), listings, DAY + datetime.timedelta(hours=hour))

    def run():
        stream = spark.readStream.schema(edits.LISTING).parquet(listings)
        edits.ingest_edits(
            stream, edits.fetch_named(spark, str(tree)), target, str(tmp_path / "ck"), module="m", make=hashed_words(8), missing_after="30 minutes"
        ).awaitTermination()

    def found():
        rows = store.read_store(spark, f"{target}/store").select("relative_path", F.coalesce("method_name", "class_name").alias("name"))
        return sorted(tuple(r) for r in rows.collect())

    for name in ("a.gs", "sub/b.gs", "c.gs"):
        put(tree, name, CODE.format(name[-4].upper(), "one"), 0)
    put(tree, "broken.gs", "class X {\n", 0)
    listed(0)
    run()
    assert found() == sorted((n, x) for n, c in (("a.gs", "A"), ("sub/b.gs", "B"), ("c.gs", "C")) for x in (c, "one"))

    put(tree, "a.gs", CODE.format("A", "two"), 1)
    os.remove(tree / "sub/b.gs")
    put(tree, "new.gs", CODE.format("N", "three"), 1)
    listed(1)
    run()
    # The removed file's timer runs out with the batch that follows the listing.
    assert found() == sorted([("a.gs", "A"), ("a.gs", "two"), ("c.gs", "C"), ("c.gs", "one"), ("new.gs", "N"), ("new.gs", "three")])
    recorded = {os.path.basename(r["path"]): r["chunk_count"] for r in manifests.read_manifest(spark, f"{target}/manifest").collect()}
    assert recorded == {"a.gs": 2, "c.gs": 2, "new.gs": 2}
    log = runlog.read_log(spark, f"{target}/runlog")
    told = {}
    for r in log.orderBy("session_id").collect():
        told.setdefault(r["relative_path"], []).append(r["status"])
    assert told == {
        "a.gs": ["success", "success"], "c.gs": ["success", "skipped"], "sub/b.gs": ["success"], "new.gs": ["success"], "broken.gs": ["parse_error", "skipped"],
    }

    # It comes back, and an older listing that comes late says nothing.
    put(tree, "sub/b.gs", CODE.format("B", "again"), 2)
    listed(2)
    run()
    assert ("sub/b.gs", "again") in found() and len(found()) == 8
    os.remove(tree / "c.gs")
    listed(0.5)
    run()
    assert len(found()) == 8
    assert not [n for n in os.listdir(target) if n.startswith("lexhaven-")]


def rows_of(spark, rows):
    from lexhaven.schemas import STORE, conform

    df = spark.createDataFrame(rows, "id string, absolute_path string, content string")
    full = df.withColumns({c: F.lit(None) for c in STORE.fieldNames() if c not in df.columns})
    return conform(full, STORE)


def ids(spark, path):
    return sorted((r["id"], r["content"]) for r in store.read_store(spark, path).collect())


def test_tombstones(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append_rows(rows_of(spark, [(f"{f}{i}", f, "old") for f in "abc" for i in range(3)]), path)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    # Replacing one file writes its rows and one tombstone, and touches nothing else.
    store.replace_rows(rows_of(spark, [("a1", "a", "new")]), path)
    assert ids(spark, path) == [("a1", "new")] + [(f"{f}{i}", "old") for f in "bc" for i in range(3)]
    assert {p: p.stat().st_mtime_ns for p in before} == before
    assert spark.read.parquet(f"{path}/{store.TOMBSTONES}").count() == 1

    gone = spark.createDataFrame([("b",), ("b",), ("none",)], "path string")
    store.replace_rows(rows_of(spark, []), path, gone)
    left = [("a1", "new")] + [(f"c{i}", "old") for i in range(3)]
    assert ids(spark, path) == left
    # Rows written after a tombstone live, also by a plain upsert.
    store.append_rows(rows_of(spark, [("b7", "b", "back")]), path)
    left = sorted(left + [("b7", "back")])
    assert ids(spark, path) == left
    store.compact(spark, path)
    assert ids(spark, path) == left and not os.path.exists(f"{path}/{store.TOMBSTONES}")
    store.replace_rows(rows_of(spark, []), path, spark.createDataFrame([("c",)], "path string"))
    assert ids(spark, path) == [("a1", "new"), ("b7", "back")]


def test_sessions_are_replaced_whole(spark, tmp_path):
    from lexhaven.schemas import RUNLOG

    def rows(session, *names):
        return spark.createDataFrame([(DAY, session, n, n, "success", 1, None, None, None, None, 5) for n in names], RUNLOG)

    path = str(tmp_path / "log")
    runlog.append_log(rows("s1", "a", "b"), path)
    runlog.write_session(rows("s2", "a"), path)
    runlog.write_session(rows("s2", "c"), path)
    assert sorted((r["session_id"], r["file_path"]) for r in runlog.read_log(spark, path).collect()) == [("s1", "a"), ("s1", "b"), ("s2", "c")]


class Held:
    """A bucket's state and timers as Spark keeps them, counting what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.asked += 1
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value

    def clear(self):
        self.asked += 1
        self.value = None

    def registerTimer(self, at):
        self.asked += 1
        assert at not in self.timers
        self.timers.add(at)

    def deleteTimer(self, at):
        self.asked += 1
        self.timers.remove(at)


class Fired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def rows_seen(moment, states):
    import pandas as pd

    return pd.DataFrame({
        "listed": pd.Timestamp(moment, unit="ms"), "path": [p for p, _ in states], "relative_path": [p for p, _ in states], "ext": ".gs",
        "modification_time": moment * 1000, "state": [s for _, s in states], "moment": moment, "bucket": 0,
    })


def told(frames):
    return sorted(((r["path"] or "", r["status"]) for f in frames for r in f.to_dict("records")))


def test_paths_of_a_bucket_are_one_state(spark):
    # Each path was a group of its own, with calls into Python and several questions to the state.
    import random

    held, missing = Held(), 25
    seen = edits._Seen(missing)
    seen.init(held)
    states, rng = {}, random.Random(3)
    for moment in (100, 110, 105, 120, 150, 160, 190, 300):
        listing = [(p, rng.choice("xy")) for p in rng.sample([None, *(f"p{n}" for n in range(40))], 30)]
        listing += [(p, "z") for p, _ in listing[:3]]
        newest = dict(sorted(listing, key=lambda r: r[1]))
        expected = []
        for path, state in newest.items():
            before = states.get(path)
            if before is None or moment >= before[0]:
                expected.append((path or "", "new" if before is None else "unchanged" if before[1] == state else "changed"))
                states[path] = (moment, state)
        half = len(listing) // 2
        held.asked = 0
        got = told(seen.handleInputRows((0,), iter([rows_seen(moment, listing[:half]), rows_seen(moment, listing[half:])]), None))
        assert got == sorted(expected) and held.asked <= 3 + 2 * len(held.timers) + 4
        assert held.timers == {m + missing for m, _ in states.values()}
        # Timers up to the watermark run out after the rows.
        for at in sorted(t for t in held.timers if t <= moment - 5):
            held.timers.remove(at)
            gone = [p for p, (m, _) in states.items() if m + missing <= at]
            assert told(seen.handleExpiredTimer((0,), None, Fired(at))) == sorted((p or "", "deleted") for p in gone)
            for p in gone:
                del states[p]
    assert states


def test_state_that_is_null_stays_unchanged(spark):
    held = Held()
    seen = edits._Seen(25)
    seen.init(held)
    assert told(seen.handleInputRows((0,), iter([rows_seen(10, [("a", None), ("b", "x")])]), None)) == [("a", "new"), ("b", "new")]
    assert told(seen.handleInputRows((0,), iter([rows_seen(20, [("a", None), ("b", None)])]), None)) == [("a", "unchanged"), ("b", "changed")]
    assert held.timers == {45}


def test_edits_write_pieces_once_and_nothing_without_events(spark, tmp_path, state_store, monkeypatch):
    # Pieces were written to a work folder and again to the store, also by batches without any.
    from lexhaven.sources import tables

    moved, place = [], tables._place
    monkeypatch.setattr(tables, "_place", lambda s, staged, *rest: moved.append(staged) or place(s, staged, *rest))
    tree, listings, target = tmp_path / "tree", str(tmp_path / "listings"), str(tmp_path / "target")
    for n in range(5):
        put(tree, f"f{n}.gs", CODE.format(f"F{n}", "one"), 0)
    edits.append_listing(spark, str(tree), listings, DAY)
    stream = spark.readStream.schema(edits.LISTING).parquet(listings)
    fetch = edits.fetch_named(spark, str(tree))
    edits.ingest_edits(stream, fetch, target, str(tmp_path / "ck"), make=hashed_words(8), buckets=2).awaitTermination()
    assert len([p for p in moved if "/store/" in p]) == 1 and all("/store/aside-" in p for p in moved if "/store/" in p)
    assert sorted(os.listdir(f"{target}/store")) == ["gen=1", store.TOMBSTONES]
    assert store.read_store(spark, f"{target}/store").count() == 10

    def failing():
        def fn(texts):
            raise RuntimeError("429")

        return fn

    # A batch that fails to embed leaves the rows of its files as they were, and no folder aside.
    put(tree, "f1.gs", CODE.format("F1", "two"), 1)
    edits.append_listing(spark, str(tree), listings, DAY + datetime.timedelta(hours=1))
    edits.ingest_edits(stream, fetch, target, str(tmp_path / "ck"), make=failing, buckets=2).awaitTermination()
    assert store.read_store(spark, f"{target}/store").where("method_name = 'one'").count() == 5
    assert sorted(os.listdir(f"{target}/store")) == ["gen=1", store.TOMBSTONES]
    last = runlog.read_log(spark, f"{target}/runlog").where("status not in ('success', 'skipped')").collect()
    assert [r["relative_path"] for r in last] == ["f1.gs"]


def test_changing_files_are_joined_once(spark, tmp_path, plan_of):
    from lexhaven.plans import inputs

    folder = str(tmp_path)
    docs = [(1, "one"), (2, "two"), (3, "three"), (4, None), (5, "five"), (6, "six"), (6, "six"), (7, "seven")]
    labels = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 0, 1), (6, None, 1), (7, 1, None), (7, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    files = inputs.changing_files(spark, folder)
    rows = {}
    for doc, text in docs:
        for quality, toxic in [(q, t) for d, q, t in labels if d == doc] or [(None, None)]:
            found = []
            if quality is not None:
                found.append((text, 0, True, quality == 1 and toxic == 0))
            if toxic == 1:
                found.append((None if text is None else "edited " + text, 1, False, True))
            if quality is None:
                found.append((text, 1, False, True))
            for x in found:
                rows[(doc, *x)] = rows.get((doc, *x), 0) + 1
    got = {}
    for r in files.collect():
        key = (int(r.relative_path.removesuffix(".gs")), r.text, int(r.modification_time.timestamp() - 1_700_000_000) // 3600, r["first"], r["last"])
        got[key] = got.get(key, 0) + 1
    assert got == rows
    assert plan_of(files).count("labels.parquet") == 1 and plan_of(files).count("documents.parquet") == 1
    last = inputs.listing_of(files, "last", 1).collect()
    assert len(last) == sum(n for k, n in rows.items() if k[-1]) and {r.listed.timestamp() for r in last} == {1_700_003_600}
