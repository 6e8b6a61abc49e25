import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexhaven.operators import changes, upsert
from lexhaven.schemas import MANIFEST, STORE
from lexhaven.sources import manifest as manifests
from lexhaven.sources import store, tables


def at(n):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=n)


def chunks(spark, *rows):
    """Rows of `(id, path, content)`."""
    df = spark.createDataFrame(list(rows), "id string, absolute_path string, content string")
    return df.withColumns({"package": F.lit(""), "embedding": F.array(F.lit(1.0)).cast("array<float>")})


def content(df):
    return {r.id: r.content for r in df.collect()}


def test_upsert(spark):
    old = chunks(spark, ("a", "p", "1"), ("b", "p", "2"))
    new = chunks(spark, ("b", "p", "3"), ("c", "q", "4"))
    merged = upsert.upsert(old, new)
    assert content(merged) == {"a": "1", "b": "3", "c": "4"} and merged.count() == 3
    assert content(upsert.upsert(merged, new)) == content(merged)


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 1)], "id string, version int")
    assert {tuple(r) for r in upsert.latest_rows(rows, order="version").collect()} == {("a", 3), ("b", 1)}


def test_hot_id_is_cut_before_the_shuffle(spark, plan_of):
    hot = F.when(F.col("id") >= 0, "x").otherwise("y")
    rows = spark.range(1000).select(hot.alias("id"), F.col("id").alias("version"))
    plan = plan_of(upsert.latest_rows(rows, order="version"))
    assert plan.count("WindowGroupLimit") >= 2
    assert [tuple(r) for r in upsert.latest_rows(rows, order="version").collect()] == [("x", 999)]


def test_replace_files(spark):
    old = chunks(spark, ("a", "p", "1"), ("b", "p", "2"), ("c", "q", "3"), ("d", "r", "4"))
    new = chunks(spark, ("e", "p", "5"))
    gone = spark.createDataFrame([("r",)], "path string")
    assert content(upsert.replace_files(old, new, gone)) == {"e": "5", "c": "3"}
    # An upsert would leave the chunks of the earlier state.
    assert content(upsert.upsert(old, new)) == {"a": "1", "b": "2", "c": "3", "d": "4", "e": "5"}


def test_store_on_disk(spark, tmp_path, plan_of):
    path = str(tmp_path / "s")
    assert store.read_store(spark, path).count() == 0
    assert store.read_store(spark, path).columns == [f.name for f in STORE.fields]
    store.append_rows(chunks(spark, ("a", "p", "1"), ("b", "p", "2"), ("b", "p", "2")), path)
    first = store.read_store(spark, path)
    assert content(first) == {"a": "1", "b": "2"} and first.count() == 2
    assert "Exchange" not in plan_of(first)
    store.append_rows(chunks(spark, ("b", "p", "3"), ("c", "q", "4")), path)
    store.append_rows(chunks(spark, ("b", "p", "5")), path)
    store.append_rows(chunks(spark, ("b", "p", "5")), path)
    now = store.read_store(spark, path)
    assert content(now) == {"a": "1", "b": "5", "c": "4"} and now.count() == 3
    # Missing metadata is NULL.
    assert now.where("package is null").count() == 3
    store.compact(spark, path)
    packed = store.read_store(spark, path)
    assert sorted(map(str, packed.drop("version").collect())) == sorted(map(str, now.drop("version").collect()))
    assert "Exchange" not in plan_of(packed)
    store.append_rows(chunks(spark, ("a", "p", "6")), path)
    assert content(store.read_store(spark, path)) == {"a": "6", "b": "5", "c": "4"}


def test_unfinished_write_is_not_read(spark, tmp_path):
    path = str(tmp_path / "s")
    store.append_rows(chunks(spark, ("a", "p", "1")), path)
    store.append_rows(chunks(spark, ("a", "p", "2")), path)
    (tmp_path / "s/gen=1/_done-2").unlink()
    assert content(store.read_store(spark, path)) == {"a": "1"}
    (tmp_path / "s/gen=2/version=3").mkdir(parents=True)
    assert content(store.read_store(spark, path)) == {"a": "1"}
    store.append_rows(chunks(spark, ("a", "p", "3")), path)
    assert content(store.read_store(spark, path)) == {"a": "3"}


def test_store_does_not_rest_on_the_committers_markers(spark, tmp_path):
    path, name = str(tmp_path / "s"), "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set(name, "false")
    try:
        store.append_rows(chunks(spark, ("a", "p", "1")), path)
        store.append_rows(chunks(spark, ("b", "p", "2")), path)
        assert content(store.read_store(spark, path)) == {"a": "1", "b": "2"}
    finally:
        hadoop.unset(name)


def test_two_writers_get_two_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    store.append_rows(chunks(spark, ("a", "p", "1")), path)
    # Another writer has taken the next number and is not done.
    (tmp_path / "s/gen=1/_taken-2").touch()
    assert store.append_rows(chunks(spark, ("b", "p", "2")), path) == 3
    assert content(store.read_store(spark, path)) == {"a": "1", "b": "2"}


def test_old_generations_go(spark, tmp_path):
    path = str(tmp_path / "s")
    store.append_rows(chunks(spark, ("a", "p", "1")), path)
    for _ in range(3):
        store.compact(spark, path)
    assert sorted(p.name for p in (tmp_path / "s").glob("gen=*")) == ["gen=3", "gen=4"]
    assert content(store.read_store(spark, path)) == {"a": "1"}


def test_inspect(spark, tmp_path):
    full, none = str(tmp_path / "s"), str(tmp_path / "none")
    store.append_rows(chunks(spark, *[(f"c{n}", "p", "x" * 99) for n in range(5)]), full)
    got = {r["name"]: r for r in store.inspect(spark, {"full": full, "none": none}).collect()}
    assert got["full"].rows == 5 and len(got["full"].sample) == 3 and got["full"].sample[0]["head"] == "x" * 60
    assert got["none"].rows == 0 and got["none"].sample == []


FILES = [("new", "h", 5), ("same", "h", 5), ("newer", "h", 9), ("other", "i", 5), ("older", "i", 1)]
KNOWN = [("same", "h", 5, 1), ("newer", "h", 5, 1), ("other", "h", 5, 1), ("older", "h", 5, 1), ("gone", "h", 5, 1)]


@pytest.fixture()
def states(spark):
    files = spark.createDataFrame([(p, h, at(t)) for p, h, t in FILES], "path string, file_hash string, modification_time timestamp")
    known = spark.createDataFrame([(p, h, at(t), n) for p, h, t, n in KNOWN], MANIFEST)
    return files, known


def test_changes(spark, states):
    files, known = states

    def by(mode):
        return {r.path: r.status for r in changes.detect_changes(files, known, mode).collect()}

    assert by("hash") == {"new": "new", "same": "unchanged", "newer": "unchanged", "other": "changed", "older": "changed", "gone": "deleted"}
    assert by("mtime") == {"new": "new", "same": "unchanged", "newer": "changed", "other": "unchanged", "older": "unchanged", "gone": "deleted"}
    assert {r.status for r in changes.detect_changes(files, known.limit(0)).collect()} == {"new"}
    with pytest.raises(ValueError):
        changes.detect_changes(files, known, "size")


def test_manifest(spark, states, tmp_path):
    files, known = states
    path = str(tmp_path / "m")
    assert manifests.read_manifest(spark, path).count() == 0
    manifests.write_manifest(known, path)
    counts = spark.createDataFrame([("new", 4), ("other", 2)], "path string, chunk_count bigint")
    done = files.where("path in ('new', 'other', 'older')")
    current = manifests.read_manifest(spark, path)
    manifests.write_manifest(changes.update_manifest(current, done, counts), path)
    got = {r.path: (r.file_hash, r.chunk_count) for r in manifests.read_manifest(spark, path).collect()}
    # `older` has no chunks, so its record stays as it was.
    assert got == {"same": ("h", 1), "newer": ("h", 1), "older": ("h", 1), "gone": ("h", 1), "new": ("h", 4), "other": ("i", 2)}
    kept = changes.update_manifest(known, done, counts, record_empty=True, deleted=known.where("path = 'gone'"))
    assert {r.path: r.chunk_count for r in kept.collect()} == {"same": 1, "newer": 1, "older": 0, "new": 4, "other": 2}


def test_shared_folder_is_the_cluster_s(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    one, two = tables.shared_folder(spark), tables.shared_folder(spark)
    assert one != two
    assert named is None or one.startswith(named.rstrip("/") + "/lexhaven-")
