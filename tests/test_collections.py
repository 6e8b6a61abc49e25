import json

import pytest
from pyspark.sql import functions as F

from lexhaven.sources import collections, store
from test_edits import rows_of


@pytest.fixture()
def root(spark, tmp_path):
    root = str(tmp_path / "all")
    one = collections.get_or_create(spark, root, "one", {"description": "Gösu", "space": "l2"})
    store.append_rows(rows_of(spark, [(f"i{n}", f"p{n % 3}", "x") for n in range(9)]), one)
    two = collections.get_or_create(spark, root, "two")
    store.append_rows(rows_of(spark, [("a", "p", "x"), ("b", "q", "x")]), two)
    store.append_rows(rows_of(spark, [("b", "q", "y"), ("c", "q", "y")]), two)
    collections.get_or_create(spark, root, "none", {"n": 1})
    (tmp_path / "all" / "_hidden").mkdir()
    (tmp_path / "all" / "file").write_text("no collection")
    return root


def listed(spark, root):
    return {r["collection"]: (r["rows"], r["files"] > 0, json.loads(r["metadata"])) for r in collections.list_collections(spark, root).collect()}


def test_list(spark, root):
    assert listed(spark, root) == {
        "one": (9, True, {"description": "Gösu", "space": "l2"}), "two": (3, True, {}), "none": (0, False, {"n": 1}),
    }
    store.replace_rows(rows_of(spark, []), f"{root}/one", spark.createDataFrame([("p1",)], "path string"))
    store.compact(spark, f"{root}/two")
    got = listed(spark, root)
    assert (got["one"][0], got["two"][0]) == (6, 3)
    assert listed(spark, root + "/empty") == {}


def test_source_and_filters(spark, root):
    files = collections.collection_files(spark, root)
    assert {(r["collection"], r["rows"]) for r in files.where("file is not null").groupBy("collection").agg(F.sum("rows").alias("rows")).collect()} == {
        ("one", 9), ("two", 4),
    }
    assert files.rdd.getNumPartitions() == 3
    two = collections.collection_files(spark, root, ["two", "absent"])
    assert two.rdd.getNumPartitions() == 1 and {r["version"] for r in two.collect()} == {1, 2}
    assert collections.collection_files(spark, root, []).count() == 0
    # One frame read by different filters gives each its rows.
    assert [files.where(f"collection = '{n}'").count() > 0 for n in ("one", "two", "none", "absent")] == [True, True, True, False]
    assert files.select("collection").distinct().count() == 3


def test_rows_of_several(spark, root):
    got = collections.read_collections(spark, root).groupBy("collection").count().collect()
    assert {tuple(r) for r in got} == {("one", 9), ("two", 3)}
    assert collections.read_collections(spark, root, ["two"]).where("content = 'y'").count() == 2


def test_get_or_create(spark, root):
    path = collections.get_or_create(spark, root, "one", {"description": "other"})
    assert listed(spark, root)["one"][2]["description"] == "Gösu" and store.read_store(spark, path).count() == 9
    for name in ("", "a/b", "_x", ".x"):
        with pytest.raises(ValueError):
            collections.get_or_create(spark, root, name)
