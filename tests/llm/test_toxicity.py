import random

import numpy as np
from pyspark.sql import functions as F

from lexhaven.llm import toxicity
from lexhaven.llm.common import fold


def kernel(a, b):
    """Sum over pairs of equal triples of both words, by their spans."""
    def triples(w):
        w = b"^" + w
        return [((w[i], w[j], w[k]), toxicity.DECAY ** (k - i + 1)) for i in range(len(w)) for j in range(i + 1, len(w))
                for k in range(j + 1, min(len(w), i + toxicity.SPAN))]
    value = lambda x, y: sum(p * q for s, p in triples(x) for t, q in triples(y) if s == t)
    return value(a, b) / np.sqrt(value(a, a) * value(b, b))


def test_kernel_against_brute_force():
    words = [b"idiot", b"idxiot", b"moron", b"other", b"aaaaa"]
    rows = toxicity.vectors(words)
    for i, a in enumerate(words):
        table = rows[i]
        got = toxicity.margins(words, table)
        assert np.allclose(got, [kernel(a, b) for b in words], atol=1e-5)


def test_gaps_and_spelling():
    word = lambda w: toxicity.letters(w.encode())
    assert word("I-d.i*o_t!") == b"idiot" and toxicity.spelled(b"you i d i o t, go") == [b"idiot"]
    assert toxicity.spelled(b"a b") == [] and kernel(b"idiot", b"idxiot") > 2 * kernel(b"idiot", b"thing")


def test_learns_from_texts():
    rng = random.Random(2)
    plain = ["the", "house", "of", "many", "rooms", "stands", "near", "water", "and", "trees"]
    texts, labels = [], []
    for n in range(400):
        words = [rng.choice(plain) + rng.choice(["", "s", "ed"]) for _ in range(30)]
        if n % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["blockhead", "nitwit", "dunce"])
        texts.append(" ".join(words))
        labels.append(int(n % 4 == 0))
    model = toxicity.fit(texts, labels)
    p = lambda w: float(model.probability(toxicity.margins([w], model.table) + model.offset)[0])
    assert min(p(b"blockhead"), p(b"nitwit"), p(b"dunce")) > 0.8 > 0.3 > max(p(w.encode()) for w in plain)
    assert p(b"blocckhead") > 10 * p(b"houseboat")


def test_held_out_documents(spark):
    """Accuracy on the fold that is not learned from; clean texts stay clean."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    held_out = fold(F.col("doc_id"), 5) == 0
    got = toxicity.toxicity(read("documents"), read("labels"), ~held_out, held_out)
    rows = got.where("held_out").join(read("labels"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.collect())


def test_edges(edges, docs, spark):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(edges, labels, F.lit(True), F.lit(False)).collect()}
    assert len(rows) == 7 and rows[1].score == rows[2].score == rows[3].score and rows[5].score == rows[6].score
    alone = toxicity.toxicity(edges, labels.limit(0), F.lit(True), F.lit(False)).collect()
    assert {r.predicted for r in alone} == {0}
    assert toxicity.toxicity(docs([]), labels, F.lit(True), F.lit(False)).count() == 0


def test_one_id_on_many_rows_is_learned_from_once(spark):
    many = spark.range(10_000).select((F.col("id") % 10_000 == 0).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    texts, marks, _ = toxicity.training_rows(many, labels, F.lit(True), "doc_id", "text", "toxic", 2000)
    assert (texts, marks) == (["1", "0"], [1, 0])
