import os
import warnings

import pytest
from pyspark.sql import functions as F

from lexhaven.sources import files as sources


def write(path, data=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("Tree")
    for name in ("a.gs", "b.gsx", "c.gst", "d.txt", "E.GS", "one/f.gs", "one/two/three/g.gs", "with space/h[1].gs",
                 "node_modules/n.gs", "one/build/m.gs", "one/builder/k.gs", "x.gs.bak", "empty.gs"):
        write(root / name, b"" if name == "empty.gs" else name)
    write(root / "bad.gs", b"ok \xff\xfe end \xc3\xa9")
    write(root / ".hidden/i.gs")
    write(root / "_under.gs")
    write(root / ".gs")
    os.symlink(root / "a.gs", root / "link.gs")
    os.symlink(root / "one", root / "linked")
    return root


PLAIN = {
    "a.gs", "b.gsx", "c.gst", "one/f.gs", "one/two/three/g.gs", "with space/h[1].gs", "one/builder/k.gs",
    "bad.gs",
}


def names(df):
    return {r.relative_path for r in df.select("relative_path").collect()}


def test_discovery(spark, tree):
    # Spark's own listing follows links to folders and files.
    got = {n for n in names(sources.discover_files(spark, str(tree))) if "link" not in n}
    assert got == PLAIN


def test_discovery_with_hidden_names_and_without_links(spark, tree):
    got = names(sources.discover_files(spark, str(tree), list_hidden=True))
    assert got == PLAIN | {".hidden/i.gs", "_under.gs", "empty.gs"}
    flat = names(sources.discover_files(spark, str(tree), max_depth=0, list_hidden=True))
    assert flat == {n for n in PLAIN if "/" not in n} | {"_under.gs", "empty.gs"}


@pytest.mark.parametrize("hidden", [False, True])
def test_both_listings_agree_on_states(spark, tree, hidden):
    df = sources.discover_files(spark, str(tree), [".gsx"], list_hidden=hidden)
    row = sources.read_text(df).first()
    info = os.stat(tree / "b.gsx")
    assert row.path == str(tree / "b.gsx") and row.length == info.st_size and row.text == "b.gsx"
    assert abs(row.modification_time.timestamp() - info.st_mtime) < 0.01


def test_options(spark, tree):
    def found(**options):
        return {n for n in names(sources.discover_files(spark, str(tree), **options)) if "link" not in n}

    assert found(max_depth=0) == {n for n in PLAIN if "/" not in n}
    assert found(max_depth=1) == {n for n in PLAIN if n.count("/") <= 1}
    assert found(extensions=[".txt"]) == {"d.txt"}
    assert found(exclude_dirs=["one"]) == {n for n in PLAIN if not n.startswith("one/")} | {"node_modules/n.gs"}
    assert found(exclude_dirs=[]) == PLAIN | {"node_modules/n.gs", "one/build/m.gs"}


def test_excluded_root_is_searched(spark, tree):
    assert names(sources.discover_files(spark, str(tree / "node_modules"))) == {"n.gs"}


def test_single_file(spark, tree):
    row = sources.discover_files(spark, str(tree / "one/f.gs")).first()
    assert (row.relative_path, row.ext) == ("f.gs", ".gs")
    row = sources.discover_files(spark, str(tree / "one/f.gs"), source_root=str(tree)).first()
    assert row.relative_path == "one/f.gs"
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert sources.discover_files(spark, str(tree / "d.txt")).count() == 0
    assert any("does not match" in str(w.message) for w in seen)


def test_text_and_language(spark, tree):
    got = {r.relative_path: r for r in sources.read_text(sources.discover_files(spark, str(tree))).collect()}
    assert got["bad.gs"].text == "ok �� end é"
    assert {got[n].language for n in ("a.gs", "b.gsx")} == {"gosu"} and got["c.gst"].language == "gosu_template"


def test_excluded_files_are_not_opened(spark, tree, plan_of):
    plan = plan_of(sources.discover_files(spark, str(tree)))
    assert "_metadata.file_path" in plan or "file_path" in plan


def test_named_files(spark, tree):
    listing = sources.discover_files(spark, str(tree))
    rows = listing.where(F.col("relative_path").isin("a.gs", "with space/h[1].gs"))
    for wanted in (rows.select("path"), rows.select("path", "modification_time")):
        got = sources.read_text(sources.read_named(listing, wanted)).collect()
        assert {r.text for r in got} == {"a.gs", "with space/h[1].gs"}
        assert sources.read_named(listing, wanted.limit(0)).count() == 0


def test_stats_and_module(spark, tree):
    df = sources.discover_files(spark, str(tree), exclude_dirs=[], max_depth=0)
    assert {r.ext: r.files for r in sources.file_stats(df).collect()}[".gst"] == 1
    assert sources.module_of("/x/MyApp/") == "myapp"


def test_unknown_language(spark):
    got = spark.createDataFrame([(".gs",), (".txt",), ("",)], "e string").select(sources.language_of(F.col("e")).alias("l"))
    assert [r.l for r in got.collect()] == ["gosu", None, None]


def test_small_files_share_a_batch(spark, tmp_path, monkeypatch):
    # Each file made an Arrow batch of its own.
    import pyarrow as pa

    for n in range(30):
        (tmp_path / f"_f{n}.gs").write_text(f"class A{n} {{}}")
    (tmp_path / "big.gs").write_bytes(b"x" * (sources.READ_BYTES + 1))
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: run)
    read = sources._walk(spark, str(tmp_path), [".gs"], [], -1)
    paths = sorted((str(p) for p in tmp_path.glob("*.gs")), reverse=True)
    made = list(read(iter([pa.record_batch({"path": paths})])))
    assert sum(b.num_rows for b in made) == 31 and len(made) == 2
    assert {p.removeprefix("file:") for b in made for p in b.column("path").to_pylist()} == set(paths)
