import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexhaven.llm import queries, resample
from lexhaven.llm.common import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=1):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def by_hand(docs, target, percent=10, longest=1, buckets=10_000, seed=2024, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, counts in ((docs.values(), s), (target, t)):
        for text in texts:
            for f in features(text, longest)[1]:
                counts[bucket(f)] += 1
    total_s, total_t = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((b + 1.0) * (total_s + buckets) / ((a + 1.0) * (total_t + buckets)))) for a, b in zip(s, t)]
    rows, able = {}, []
    for key, text in docs.items():
        words, found = features(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows[key] = [len(found), weight, score, None]
        if len(words) >= least:
            able.append((-score, key))
    for i, (_, key) in enumerate(sorted(able)[:len(able) * percent // 100]):
        rows[key][3] = i + 1
    return {k: tuple(v) for k, v in rows.items()}


def result(df, key="doc_id"):
    return {r[key]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()}


def test_whole_query_against_brute_force(spark, given):
    docs = {r["doc_id"]: r["text"] for r in given("documents").collect()}
    got = result(queries.op13_importance_resampling(spark, "/root/testdata/sf0.001"))
    assert got == by_hand(docs, [r["text"] for r in given("benchmark").collect()])


def test_runs_of_words_and_other_settings(spark, docs):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["a", "Bé", "c1", "D-e", "\x7f", "日本", "x" * 300]) for _ in range(rng.randint(0, 30))) for i in range(120)}
    target = ["a bé a bé", None, "日本 c1"]
    got = resample.resampled(docs(texts.items()), docs(enumerate(target)), percent=37, longest=3, buckets=101, seed=7, least_words=5)
    assert result(got) == by_hand(texts, target, 37, 3, 101, 7, 5)


def test_edges(spark, docs, edges):
    got = result(resample.resampled(edges, docs([]), percent=50, least_words=2))
    want = by_hand({r["doc_id"]: r["text"] for r in edges.collect()}, [], 50, least=2)
    assert got == want and got[1][:2] == (0, 0) and sum(v[3] is not None for v in got.values()) == 1
    assert resample.resampled(docs([]), docs([(1, "a")])).count() == 0
    assert {r["rank"] for r in resample.resampled(edges, edges, percent=0).collect()} == {None}


def test_repeated_and_unknown_keys(spark, docs):
    same = docs([(None, "a b c")] * 40 + [(7, "a b c")] * 60)
    rows = resample.resampled(same, docs([(1, "a")]), percent=50, least_words=1).collect()
    assert len(rows) == 100 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 51))


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_quickselect(spark, k):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    want = sorted((i % 7, i) for i in range(1000))[k - 1]
    assert resample.kth(df, ["a", "b"], k, seed=k, parts=4) == want
    assert resample.kth(df, ["a", "b"], 1001) is None


def test_quickselect_counts_equal_keys(spark):
    df = spark.createDataFrame([(1,)] * 300 + [(2,)] * 400 + [(3,)], "a int")
    assert [resample.kth(df, ["a"], k)[0] for k in (300, 301, 700, 701)] == [1, 2, 2, 3]


def test_ranks_are_gapless(spark, tmp_path):
    df = written(spark.range(5000).select((F.col("id") * 7919 % 5000).alias("a")), f"{tmp_path}/rows")
    got = resample.ranked(df, ["a"], f"{tmp_path}/ranked").collect()
    assert sorted((r["rank"], r["a"]) for r in got) == [(i + 1, i) for i in range(5000)]
