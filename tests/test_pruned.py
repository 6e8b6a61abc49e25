import numpy as np
import pytest
from pyspark.sql import functions as F

from lexhaven.operators import pruned, search
from test_search import STORE, brute, ranked, store_rows

rng = np.random.default_rng(11)


def clustered_rows(n, dim=8, centres=12):
    rows = store_rows(n, dim)
    middles = rng.normal(size=(centres, dim)) * 20
    return [r[:-1] + ([float(np.float32(x + m)) for x, m in zip(r[-1], middles[i % centres])],) for i, r in enumerate(rows)]


def run(spark, rows, queries, path, n=None, schema="query_id int, embedding array<float>", **options):
    store = spark.createDataFrame(rows, STORE).repartition(3)
    pivots = pruned.choose_pivots(store, n)
    indexed = pruned.with_clusters(store, pivots)
    asked = spark.createDataFrame(queries, schema)
    return pruned.search_pruned(indexed, pivots, asked, str(path), **options)


def test_rows_of_the_full_search_with_fewer_comparisons(spark, tmp_path):
    rows = clustered_rows(480)
    queries = [(i, rows[i * 7][-1]) for i in range(40)]
    got = run(spark, rows, queries, tmp_path, k=5, block_rows=16).cache()
    assert ranked(got) == brute(rows, queries, 5)
    assert got.agg(F.max("compared")).first()[0] < 0.3 * len(rows)
    full = search.search(spark.createDataFrame(rows, STORE), spark.createDataFrame(queries, "query_id int, embedding array<float>"), k=5)
    assert got.drop("compared").exceptAll(full.select(got.drop("compared").columns)).count() == 0


@pytest.mark.parametrize("n", [1, 3, 300])
def test_any_number_of_pivots(spark, tmp_path, n):
    rows = store_rows(90, copies=True)
    queries = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(9)] + [(99, rows[0][-1])]
    assert ranked(run(spark, rows, queries, tmp_path, n, k=7, block_rows=4)) == brute(rows, queries, 7)


def test_filters_and_settings_of_single_queries(spark, tmp_path):
    rows = clustered_rows(200)
    kinds = ["class", "function", None, ""]
    queries = [(i, rows[i][-1], kinds[i % 4], 1 + i % 6) for i in range(16)]
    keep = lambda q, r: (not q[2] or r[7] == q[2]) and r[3] == "p1"
    got = ranked(run(spark, rows, queries, tmp_path, schema="query_id int, embedding array<float>, chunk_type string, k int", filters={"package": "p1"}))
    assert got == {q[0]: brute(rows, [q], q[3], keep)[q[0]] for q in queries}


def test_few_or_no_vectors(spark, tmp_path):
    rows = store_rows(4)
    queries = [(1, rows[0][-1]), (2, None)]
    assert ranked(run(spark, rows, queries, tmp_path / "a", k=10)) == brute(rows, queries[:1], 10)
    assert run(spark, rows, queries, tmp_path / "b", filters={"package": "none"}).count() == 0
    assert run(spark, [r[:-1] + (None,) for r in rows], queries, tmp_path / "c").count() == 0
    assert run(spark, rows, [(2, None)], tmp_path / "d").count() == 0
    far = ranked(run(spark, clustered_rows(60), [(1, [1e6] * 8)], tmp_path / "e", k=3, min_score=0.9))
    assert far == {}


def test_probes_come_in_small_batches(spark, monkeypatch):
    # A query that visits all clusters repeated its vector for each of them in one batch.
    rows = store_rows(90)
    store = spark.createDataFrame(rows, STORE)
    pivots = pruned.choose_pivots(store, 40)
    clusters = pruned.with_clusters(store, pivots).groupBy("cluster").agg(
        F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most")).toPandas()
    asked = spark.createDataFrame([(n, rows[n][-1], 10_000) for n in range(80)], "query_id int, embedding array<float>, _k int")
    batches = asked.toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(type(asked), "mapInArrow", lambda self, run, schema: run)
    sizes = [len(b) for b in pruned._probes(asked, pivots, clusters, True)(iter(batches))]
    assert sum(sizes) == 80 * len(clusters) > max(sizes) <= pruned.PROBE_ROWS
