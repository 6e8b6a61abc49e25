import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexhaven.operators import embedding, render, search
from lexhaven.operators.embedding import hashed_words

rng = np.random.default_rng(7)

STORE = (
    "id string, content string, relative_path string, package string, class_name string, "
    "enclosing_class string, method_name string, chunk_type string, language string, "
    "line_start int, line_end int, embedding array<float>"
)


def store_rows(n=300, dim=8, copies=None):
    vectors = rng.normal(size=(n, dim)).astype("float32")
    if copies:
        # A third of all rows are copies of one vector.
        vectors[: n // 3] = vectors[0]
    return [
        (
            f"c{i:04d}", f"text {i}", f"src/p{i % 3}/f{i % 7}.gs", f"p{i % 3}", f"C{i % 5}" if i % 2 else None,
            f"C{i % 4}", None if i % 2 else f"m{i}", ("class", "function")[i % 2], "gosu", 1, 2,
            [float(x) for x in vectors[i]],
        )
        for i in range(n)
    ]


def brute(rows, queries, k, keep=lambda q, r: True):
    out = {}
    for q in queries:
        found = []
        for r in rows:
            if keep(q, r):
                gap = np.array(r[-1], dtype="float64") - np.array(q[1], dtype="float64")
                found.append((round(float((gap * gap).sum()), 9), r[0]))
        out[q[0]] = [(n + 1, i) for n, (d, i) in enumerate(sorted(found)[:k])]
    return out


def ranked(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id))
    return out


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("route", ["broadcast", "blocks"])
def test_equals_brute_force(spark, copies, route):
    rows = store_rows(copies=copies)
    queries = [(n, rows[n * 5][-1]) for n in range(20)] + [(99, [0.0] * 8)]
    options = {} if route == "broadcast" else {"broadcast_queries": 3, "block_bytes": 640}
    hits = search.search(
        spark.createDataFrame(rows, STORE).repartition(5),
        spark.createDataFrame(queries, "query_id int, embedding array<float>"), k=7, **options,
    )
    assert ranked(hits) == brute(rows, queries, 7)


@pytest.mark.parametrize("options", [{}, {"broadcast_queries": 1, "block_bytes": 1000}])
def test_filters_of_single_queries(spark, options):
    rows = store_rows()
    tests = [
        (0, None, None, None, None), (1, "p1", None, None, ""), (2, "p1", "C1", None, None),
        (3, None, None, "function", None), (4, None, None, None, "p2/f3"), (5, "nowhere", None, None, None),
        (6, "p0", "C3", "function", "f3"),
    ]
    queries = [(t[0], rows[t[0]][-1], *t[1:], 4) for t in tests]
    df = spark.createDataFrame(
        queries, "query_id int, embedding array<float>, package string, class_name string, "
        "chunk_type string, relative_path string, k int",
    )

    def keep(q, r):
        return (
            (not q[2] or r[3] == q[2]) and (not q[3] or r[4] == q[3])
            and (not q[4] or r[7] == q[4]) and (not q[5] or q[5] in r[2])
        )

    got = ranked(search.search(spark.createDataFrame(rows, STORE), df, **options))
    assert got == {q: h for q, h in brute(rows, queries, 4, keep).items() if h}


def test_filters_for_all_queries(spark):
    rows = store_rows()
    df = spark.createDataFrame(rows, STORE)
    filters = {"package": "p1", "relative_path": "f3", "class_name": "", "language": None}
    hits = search.search(
        df, spark.createDataFrame([(0, rows[0][-1])], "query_id int, embedding array<float>"), filters=filters
    )
    want = brute(rows, [(0, rows[0][-1])], 10, lambda q, r: r[3] == "p1" and "f3" in r[2])
    assert ranked(hits) == want
    one = search.nearest(df, rows[0][-1], filters=filters, query_id=0)
    assert ranked(one) == want
    with pytest.raises(ValueError):
        search.metadata_filter({"colour": "red"})


def test_class_name_with_its_members(spark):
    df = spark.createDataFrame(store_rows(), STORE)
    alone = df.where(search.metadata_filter({"class_name": "C1"})).count()
    more = df.where(search.metadata_filter({"class_name": "C1"}, match_enclosing=True)).count()
    assert more > alone > 0
    both = {"class_name": "C1", "chunk_type": "class"}
    assert df.where(search.metadata_filter(both)).count() == 0


def test_min_score_cuts_after_the_top_k(spark):
    rows = store_rows()
    df = spark.createDataFrame(rows, STORE)
    queries = spark.createDataFrame([(0, rows[0][-1])], "query_id int, embedding array<float>")
    all_hits = search.search(df, queries, k=6).collect()
    limit = sorted(r.score for r in all_hits)[3]
    assert search.search(df, queries, k=6, min_score=limit).count() == 3
    assert search.nearest(df, rows[0][-1], k=6, min_score=limit).count() == 3
    own = queries.withColumn("min_score", F.lit(limit))
    assert search.search(df, own, k=6).count() == 3


def test_hits_without_text_are_left_out(spark):
    rows = [("a", "", [0.0]), ("b", None, [0.1]), ("c", "x", [0.2])]
    df = spark.createDataFrame(rows, "id string, content string, embedding array<float>")
    queries = spark.createDataFrame([(0, [0.0])], "query_id int, embedding array<float>")
    assert [r.id for r in search.search(df, queries, k=3).collect()] == ["c"]
    assert [r.id for r in search.nearest(df, [0.0], k=3).collect()] == ["c"]


def test_no_queries_and_no_store(spark):
    df = spark.createDataFrame(store_rows(5), STORE)
    queries = spark.createDataFrame([(0, [0.0] * 8)], "query_id int, embedding array<float>")
    assert search.search(df, queries.limit(0)).count() == 0
    assert search.search(df.limit(0), queries).count() == 0
    assert search.search(df.limit(0), queries, broadcast_queries=0).count() == 0


def test_wrong_dimension_is_an_error(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0])], "query_id int, embedding array<float>")
    with pytest.raises(Exception, match="expected"):
        search.search(df, queries).collect()


def test_plans(spark, plan_of, tmp_path):
    rows = store_rows(50)
    spark.createDataFrame(rows, STORE).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    one = plan_of(search.nearest(df, rows[0][-1], filters={"package": "p1", "relative_path": "f3"}))
    assert "EqualTo(package,p1)" in one and "StringContains(relative_path,f3)" in one
    assert "TakeOrderedAndProject" in one and "EvalPython" not in one and "InPandas" not in one
    queries = spark.createDataFrame([(0, rows[0][-1])], "query_id int, embedding array<float>")
    many = plan_of(search.search(df, queries, filters={"package": "p1"}))
    assert many.count("EqualTo(package,p1)") >= 2 and "WindowGroupLimit" in many
    assert "CartesianProduct" not in many and "BroadcastNestedLoopJoin" not in many
    blocks = plan_of(search.search(df, queries, broadcast_queries=0))
    assert "CartesianProduct" not in blocks and "BroadcastNestedLoopJoin" not in blocks


# --- embedding ---


def test_hashed_words_equal_grouping(spark):
    texts = ["The cat, the CAT sat.", "", "---", "Über façade über", "a\nb\tc a"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r.n: r.embedding for r in embedding.embed(df, hashed_words(16), "text").collect()}
    words = df.select("n", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(embedding.WORD), F.lit(0))).alias("w"))
    places = words.groupBy("n", (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint") % 16).alias("p")).count()
    want = {n: np.zeros(16) for n in got}
    for r in places.collect():
        want[r.n][r.p] = r["count"]
    for n, vector in want.items():
        norm = np.linalg.norm(vector)
        assert np.allclose(got[n], vector / norm if norm else vector, atol=1e-6)


def test_batches_and_one_model_per_task(spark):
    def make():
        seen = []

        def fn(texts):
            seen.append(len(texts))
            return [[len(seen), len(texts)] for _ in texts]

        return fn

    df = spark.range(0, 25, 1, 1).select(F.col("id").cast("string").alias("content"))
    got = [tuple(r.embedding) for r in embedding.embed(df, make, batch_size=10).collect()]
    assert got == [(1, 10)] * 10 + [(2, 10)] * 10 + [(3, 5)] * 5


def test_failed_batches(spark):
    def make():
        def fn(texts):
            if "bad" in texts:
                raise RuntimeError("429 from the embedder")
            return [[1.0] for _ in texts]

        return fn

    df = spark.createDataFrame([("a",), ("b",), ("bad",), ("c",)], "content string").coalesce(1)
    got = {r.content: (r.embedding, r.embed_error) for r in embedding.embed(df, make, batch_size=2, on_error="keep").collect()}
    assert got["a"] == ([1.0], None) and got["b"] == ([1.0], None)
    assert got["bad"] == got["c"] == (None, "429 from the embedder")
    with pytest.raises(Exception, match="429"):
        embedding.embed(df, make, batch_size=2).collect()


def test_dimension_is_checked(spark):
    df = spark.createDataFrame([("a",)], "content string")
    with pytest.raises(Exception, match="dimension"):
        embedding.embed(df, hashed_words(8), dim=9).collect()
    vector = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    assert vector.select(embedding.checked_dimension(F.col("v"), 2)).count() == 1
    with pytest.raises(Exception, match="dimension"):
        vector.select(embedding.checked_dimension(F.col("v"), 3)).collect()
    assert embedding.model_dimension("all-minilm") == 384 and embedding.model_dimension("other") == 1024


def test_vectors_must_match_chunks(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "id string")
    good = spark.createDataFrame([("b", [2.0]), ("a", [1.0])], "id string, embedding array<float>")
    assert {(r.id, r.embedding[0]) for r in embedding.attach_vectors(chunks, good).collect()} == {("a", 1.0), ("b", 2.0)}
    for bad in (good.where("id = 'a'"), good.union(spark.createDataFrame([("c", [3.0])], good.schema))):
        with pytest.raises(Exception, match="do not match"):
            embedding.attach_vectors(chunks, bad).collect()


def test_text_search_finds_its_own_text(spark):
    texts = ["alpha beta gamma", "delta epsilon", "beta beta beta zeta"]
    df = spark.createDataFrame([(f"t{n}", t) for n, t in enumerate(texts)], "id string, content string")
    store = embedding.embed(df, hashed_words(64))
    queries = spark.createDataFrame([(0, "epsilon delta")], "query_id int, text string")
    best = search.search_text(store, queries, hashed_words(64), k=1).first()
    assert best.id == "t1" and best.score == 1.0


# --- rendering ---

HITS = (
    "query_id int, rank int, id string, relative_path string, package string, class_name string, "
    "method_name string, chunk_type string, language string, line_start int, line_end int, "
    "content string, score double"
)


def test_rendered_forms(spark):
    hits = spark.createDataFrame(
        [
            (1, 2, "b", "t.gst", None, "", None, "template_block", "gosu_template", 7, 9, "x" * 201, 0.25),
            (1, 1, "a", "p/A.gs", "p", "A", "f", "function", "gosu", 1, 3, "one\ntwo", 0.41666),
        ],
        HITS,
    )
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    human = {r.query_id: r.rendered for r in render.render_human(hits, queries).collect()}
    assert human[2] == "No results found."
    assert human[1] == (
        "\n📊 Found 2 results:\n\n"
        "\n1. Score: 41.7%\n   📁 p/A.gs\n   📦 Package: p\n   🏷️  Class: A\n   🔧 Method: f\n"
        "   📝 Type: function\n   📍 Lines: 1-3\n   💬 \"one two\"\n"
        "\n2. Score: 25.0%\n   📁 t.gst\n   📝 Type: template_block\n   📍 Lines: 7-9\n"
        "   💬 \"" + "x" * 200 + "...\"\n"
    )
    agent = {r.query_id: r.rendered for r in render.render_agent(hits, queries).collect()}
    assert agent[2] == "No relevant code found in the knowledge base."
    assert agent[1].startswith(
        "# Retrieved Code Context\n\nFound 2 relevant code chunks:\n\n---\n\n"
        "## Result 1\n\n**Location:**\n- File: `p/A.gs`\n- Lines: 1-3\n- Package: `p`\n- Class: `A`\n"
        "- Method: `f`\n- Type: function\n- Language: gosu\n\n**Code:**\n```gosu\none\ntwo\n```\n\n---\n\n"
        "## Result 2\n\n**Location:**\n- File: `t.gst`\n"
    )
    assert "```gosu-template\n" in agent[1]
    assert agent[1].endswith("---\n\n\n" + render.CONTEXT_NOTE[1:])


# --- many queries ---


def test_a_store_in_many_blocks_gives_k_rows_a_query(spark, monkeypatch):
    # Each block of the store gave k rows for each query, and queries were copied to each block.
    found = {}
    rows = store_rows(600)
    blocks = search._by_blocks
    monkeypatch.setattr(search, "_by_blocks", lambda *a: found.setdefault("rows", blocks(*a)))
    queries = spark.createDataFrame([(n, rows[n][-1]) for n in range(40)], "query_id int, embedding array<float>")
    hits = search.search(spark.createDataFrame(rows, STORE), queries, k=7, broadcast_queries=0, block_bytes=640)
    assert ranked(hits) == brute(rows, [(n, rows[n][-1]) for n in range(40)], 7)
    assert found["rows"].count() == 40 * 7


def test_parts_that_single_precision_cannot_tell_apart(spark):
    base = [1000.0 + i for i in range(8)]
    rows = [r[:-1] + ([float(np.float32(b + n * 2.0**-13)) for b in base],) for n, r in enumerate(store_rows(300))]
    queries = [(n, rows[n * 7][-1]) for n in range(30)]
    df = spark.createDataFrame(queries, "query_id int, embedding array<float>")
    for options in ({}, {"broadcast_queries": 1, "block_bytes": 640}):
        assert ranked(search.search(spark.createDataFrame(rows, STORE), df, k=6, **options)) == brute(rows, queries, 6)


def test_groups_of_copies_by_id(spark):
    rows = [r[:-1] + ([float(n % 3)] * 8,) for n, r in enumerate(store_rows(400))]
    queries = [(n, rows[n][-1]) for n in range(6)]
    df = spark.createDataFrame(queries, "query_id int, embedding array<float>")
    for options in ({}, {"broadcast_queries": 1, "block_bytes": 640}):
        assert ranked(search.search(spark.createDataFrame(rows, STORE), df, k=9, **options)) == brute(rows, queries, 9)


def test_texts_reach_python_a_batch_at_a_time(spark, monkeypatch):
    # All texts of an Arrow batch were Python strings at once, and vectors a list of objects.
    import pyarrow as pa

    caught = []
    monkeypatch.setattr(embedding.F, "arrow_udf", lambda kind: lambda run: caught.append(run) or _Stop())
    df = spark.createDataFrame([("a",)], "content string")
    with pytest.raises(_Stop):
        embedding.embed(df, hashed_words(4), batch_size=2)
    (made,) = caught[0](iter([pa.array(["a b", "", "c", "d", "e"])]))
    assert made.field("embedding").type == pa.list_(pa.float32()) and len(made) == 5
    mixed = embedding._listed([np.array([1.0, 2.0]), None])
    assert mixed.to_pylist() == [[1.0, 2.0], None] and embedding._listed([]).to_pylist() == []


class _Stop(Exception):
    def asNondeterministic(self):
        raise self


def test_hashed_words_of_many_texts_equal_one_at_a_time():
    texts = ["", " ", "ΑΣ ΑΣΑ İx Σ", "ΣΑ", "_a_b a-b\u00a0x y\x7f", "A a\na", *(f"w{n} w{n % 7} é" for n in range(1200))]
    got = hashed_words(16)()(texts)
    for text, vector in zip(texts, got, strict=True):
        counts = np.zeros(16)
        for word in re.findall(embedding.WORD, text.lower()):
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
        norm = np.sqrt(counts @ counts)
        assert vector.dtype == np.float32 and vector.tolist() == (counts / (norm or 1)).astype(np.float32).tolist()
    assert hashed_words(16)()([]) == []
