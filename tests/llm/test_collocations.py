import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexhaven.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, longest, top, percent=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and p[i:j] in often and 100 * a >= percent * often[p[i:j]]}
        scored = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def result(df, **settings):
    return sorted(tuple(r) for r in co.collocations(df, **settings).collect())


@pytest.fixture()
def small(monkeypatch):
    """Blocks, stretches and filters so small that all of them are cut and merged."""
    for name, value in (("BLOCK_BYTES", 700), ("HELD_BYTES", 1500), ("STEP_BYTES", 60), ("FILTER_RUNS", 90), ("RANGE_WORDS", 300)):
        monkeypatch.setattr(co, name, value)


def some_rows(rng, n):
    words = ["a", "B", "c", "De", "é", "日本", "x" * 40, "f g"]
    weights = [9, 7, 5, 4, 3, 2, 1, 1]
    mark = lambda: rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!\r\n"])
    text = lambda: "".join(w + mark() for w in rng.choices(words, weights, k=rng.randint(0, 40)))
    return [(rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([None, "", text(), text(), text()])) for _ in range(n)]


@pytest.mark.parametrize("setting", [(5, 5, 2000, 100), (12, 4, 15, 60), (3, 2, 50, 100)])
def test_against_brute_force(spark, small, setting):
    rows = some_rows(random.Random(setting[0]), 300) + [("en", "one two three four five six")] * 20
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    least, longest, top, percent = setting
    assert result(df, least=least, longest=longest, top=top, contained_percent=percent) == by_hand(rows, *setting)


def test_given_documents(spark, given):
    rows = [(r["lang"], r["text"]) for r in given("documents").collect()]
    want = by_hand(rows, 20, 5, 2000)
    assert len(want) > 50 and result(given("documents"), least=20) == want


def test_edges(spark, edges, docs):
    rows = [(r["lang"], r["text"]) for r in edges.collect()]
    assert result(edges) == by_hand(rows, 100, 5, 2000)
    assert result(docs([])) == [] and result(docs([(1, None), (2, "..,")])) == []


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 5), st.integers(1, 25), st.integers(0, 2**63), st.data())
def test_permutation_is_undone(n, bits, salt, data):
    shape = co.Shape.of(n, bits, data.draw(st.integers(1, 2**40)))
    numbers = [np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), min_size=4, max_size=4)), np.uint64) for _ in range(n)]
    high, low = co.permuted(shape, numbers, salt)
    assert [r.tolist() for r in co.restored(shape, high, low, salt)] == [x.tolist() for x in numbers]
    counts = np.array(data.draw(st.lists(st.integers(1, 2**40), min_size=4, max_size=4)), np.int64)
    entry = co.summed(high, low, counts)
    assert [x.tolist() for x in co.unpacked(shape, co.packed(shape, *entry))] == [x.tolist() for x in entry]


def test_all_runs_of_few_bits_stay_different():
    shape = co.Shape.of(3, 4, 1000)
    grid = np.array(np.meshgrid(*[np.arange(16)] * 3)).reshape(3, -1).astype(np.uint64)
    high, low = co.permuted(shape, list(grid), 9)
    assert len(np.unique(high)) == 16**3 and high.max() < 16**3 and not low.any()


def test_ranges_cover_all_runs():
    shape = co.Shape.of(2, 16, 100_000)
    starts = co.range_starts(shape, 7)
    assert starts[0] == 0 and (np.diff(starts.astype(np.int64)) > 0).all() and int(starts[-1]) < 2**32


def test_steps_end_with_pieces(monkeypatch):
    monkeypatch.setattr(co, "STEP_BYTES", 5)
    data, offsets = co.text_buffer(pa.array(["ab cd. ef", None, "g" * 30, "h,i"]))
    cuts = list(co.steps(data, offsets))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert {to for _, to in cuts} <= {6, 9, 39, 41, 42}


def test_too_many_words(spark, docs, monkeypatch):
    monkeypatch.setattr(co, "MOST_BITS", 2)
    with pytest.raises(ValueError):
        co.collocations(docs([(1, "a b c d e f g h")] * 3), least=2)
