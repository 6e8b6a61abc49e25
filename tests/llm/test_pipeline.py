import corpus_pipeline
from lexhaven.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark, given):
    docs = given("documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == given("documents").columns, name
        after = spark.createDataFrame(after.collect(), after.schema)
        seen.append((docs.count(), after.count()))
        docs = after
    assert all(b <= a for a, b in seen) and seen[0][1] > 0.6 * seen[0][0] and seen[3][0] == seen[3][1]
    pieces = corpus_pipeline.packing(spark, docs, SMALL)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} and out.count()


def test_empty_and_odd_documents(spark, given, edges):
    empty = given("documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
    odd = edges.selectExpr("doc_id", "text", "lang", "'s' AS source", "length(text) AS n_chars", "1 AS key", "2 AS component")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SMALL).count() >= 0


def test_all_registered():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
