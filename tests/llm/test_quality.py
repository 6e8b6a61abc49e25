import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lexhaven.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    twice = {p for i, w in enumerate(windows) if count[w] > 1 for p in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_against_brute_force(given, docs):
    rng = random.Random(3)
    made = docs([(n, " ".join(rng.choice("ab") for _ in range(n * 3)) + "\n\n a | b\n a | b") for n in range(40)])
    for source in (given("documents"), made):
        got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in quality.statistics(source).collect()}
        want = {r.doc_id: brute(r.text) for r in source.collect()}
        assert got == want


def test_no_python_and_no_shuffle(given, plan_of):
    plan = plan_of(quality.statistics(given("documents")))
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rules_are_learned():
    rng = random.Random(1)
    rows = []
    for n in range(2400):
        row = {f: rng.random() for f in quality.FEATURES} | {"key": n}
        row["bad"] = row["symbol_share"] > 0.7 or (row["upper_share"] > 0.6 and row["digit_share"] < 0.3)
        rows.append(row)
    rules = quality.learn(rows)
    wrong = [r for r in rows if any(quality.covers(rule, r) for rule in rules) != r["bad"]]
    assert 2 <= len(rules) and len(wrong) < 120
    assert quality.learn([]) == [] and quality.learn([r for r in rows if not r["bad"]]) == []


def test_given_labels(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    judged = quality.quality(read("documents"), read("labels")).join(read("labels"), "doc_id").cache()
    passed = judged.where(~F.col("base_failed"))
    good, bad = passed.where("quality = 1"), passed.where("quality = 0")
    assert good.where("not kept").count() <= 0.02 * good.count()
    assert bad.where("kept").count() <= 0.4 * max(1, bad.count())


def test_edges(edges, docs, spark):
    labels = spark.createDataFrame([(1, None), (5, 1), (99, 0), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(edges, labels).collect()}
    for n in (1, 2, 3):
        assert tuple(got[n][c] for c in COLUMNS) == (0, 0, 0, 0, 0) and got[n].base_failed and not got[n].kept
    assert got[7].n_words == 100_000 and got[7].n_repeat_words == 100_000 and got[7].base_failed
    assert quality.quality(docs([]), labels).count() == 0
    kept = quality.filtered(edges, labels)
    assert kept.columns == edges.columns and kept.count() == 0


def test_one_id_on_many_rows_is_learned_from_once(spark):
    many = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("a b c d e f g h i j k l m n o p q r s t u v "), "id").alias("text"))
    labels = spark.createDataFrame([(1, 0), (1, 0)], "doc_id long, quality int")
    assert len(quality.labelled(many, labels, "text", "doc_id", "quality", 2000)) == 1
