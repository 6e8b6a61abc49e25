import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexhaven.llm import lm
from lexhaven.llm.common import fold, mix

END = object()


def tokens(text):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), END]


def check(rows, got):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for i, text in rows:
        r, own = got[i], tokens(text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(w in count for w in own), total)
        want = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score <= 0


def scored(df):
    fold_of = fold(F.col("doc_id"), 7)
    return {r.doc_id: r for r in lm.score(df, fold_of != 2, fold_of == 2).collect()}


def test_base_score_against_brute_force(given, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", 200)  # so that many words take the join
    source = given("documents")
    rows = [(r.doc_id, r.text) for r in source.collect()]
    got = scored(source)
    check(rows, got)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 1.02 * sum(r.base_score for r in out)


def test_filter_gives_counts_back():
    keys = mix(np.arange(1, 20_001, dtype=np.uint64))
    counts = np.where(np.arange(20_000) % 100 == 0, 5000, 1 + np.arange(20_000) % 7)
    made = lm.filter_of(keys, counts)
    got = lm.middle_of(lm.levels_in(made, keys))
    # Never below the count's level; rarely above it.
    assert (got >= counts / lm.LOG_BASE - 1e-9).all() and (got <= counts * lm.LOG_BASE**2).mean() > 0.97
    assert (lm.levels_in(made, mix(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64))) > 0).mean() < 0.06
    none = np.zeros(0, np.uint64)
    assert not lm.levels_in(lm.filter_of(none, none), keys).any() and not len(lm.levels_in(made, none))


def test_numbers_there_and_back():
    for numbers in (np.zeros(0, np.uint64), np.array([0], np.uint64), np.sort(mix(np.arange(5000, dtype=np.uint64)))):
        assert (lm.unstepped(lm.steps(numbers)) == numbers).all() and (lm.unsqueezed(lm.squeezed(numbers)) == numbers).all()
    keys, counts = lm.summed([np.array([3, 1, 3], np.uint64), np.array([2], np.uint64)], [np.array([1, 2, 4]), np.array([7])])
    assert keys.tolist() == [1, 2, 3] and counts.tolist() == [2, 7, 5]


def by_hand(train, texts):
    """Scores by the same smoothing over dictionaries, a pair's count read as the middle of its level."""
    word, pair = Counter(), Counter()
    for text in train:
        own = tokens(text)
        word.update(own)
        pair.update(zip([END, *own[:-1]], own, strict=True))
    total, distinct, types = sum(word.values()), len(word), Counter(first for first, _ in pair)
    once, twice = (sum(n == k for n in pair.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once else 0.5
    out = []
    for text in texts:
        own, logs = tokens(text), 0.0
        for first, second in zip([END, *own[:-1]], own, strict=True):
            history, n = word[first], pair[first, second]
            level = 1 + math.floor(math.log(n) / math.log(lm.LOG_BASE) + 1e-9) if n else 0
            n = min(lm.LOG_BASE ** (level - 1) * (1 + lm.LOG_BASE) / 2 if level > 1 else level, word[second], history)
            rest = min(1.0, max(0.05, discount * types[first] / history)) if history else 1.0
            logs += math.log10(max(n - discount, 0) / max(history, 1) + rest * (word[second] + 1) / (total + distinct + 1))
        out.append(min(0.0, logs))
    return out


def test_score_against_brute_force(given, monkeypatch):
    """Probes find all pairs that are held, and few that are not: those alone raise a score."""
    source = given("documents")
    rows = [(r.doc_id, r.text) for r in source.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    want = by_hand([t for i, t in rows if not held[i]], [t for _, t in rows])
    for heavy in (200, lm.HEAVY):
        monkeypatch.setattr(lm, "HEAVY", heavy)
        got = scored(source)
        off = [(got[i].score - w) / max(1.0, -w) for (i, _), w in zip(rows, want, strict=True)]
        assert min(off) > -1e-6 and max(off) < 0.06 and sum(off) / len(off) < 0.03, (min(off), max(off), sum(off) / len(off))


def test_rows_that_repeat_a_key_are_rows_of_their_own(docs):
    texts = ["a b c", "d e f g", "a b c", None, "zz yy"]
    rows = docs([(1, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[3]), (None, texts[4])])
    for limit in (lm.MAX_BYTES, -1):
        got = lm.score(rows, F.col("doc_id").isNotNull(), F.lit(False), max_bytes=limit).collect()
        count = Counter(w for t in texts[:3] for w in tokens(t))
        want = [(len(tokens(t)), sum(w in count for w in tokens(t)),
                 round(sum(math.log10((count[w] + 1) / (sum(count.values()) + len(count) + 1)) for w in tokens(t)), 6)) for t in texts]
        assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(want)
        scores = by_hand(texts[:3], texts)
        assert np.allclose(sorted(r.score for r in got), sorted(scores), rtol=0.05)


def test_pairs_help(docs):
    rows = [(n, "red house blue car " * 5 if n % 2 else "blue house red car " * 5) for n in range(200)]
    got = scored(docs(rows))
    assert all(r.score > r.base_score for r in got.values())


def test_pairs_seen_once_help(docs):
    # One text of words in an order of its own, among texts that all come twice.
    twice = [(n, " ".join(f"w{(n // 2 * 7 + k * k) % 60}" for k in range(40))) for n in range(40)]
    once = (1000, " ".join(f"w{k * 17 % 60}" for k in range(60)))
    got = {r.doc_id: r for r in lm.score(docs([*twice, once]), F.lit(True), F.lit(False)).collect()}
    assert got[1000].score > 0.8 * got[1000].base_score


def test_a_model_too_large_to_send_gives_the_same_scores(given, edges, docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1 << 16)
    monkeypatch.setattr(lm, "HEAVY", 500)
    for source in (given("documents"), edges, docs([])):
        fold_of = fold(F.col("doc_id"), 7)
        sent = lm.score(source, fold_of != 2, fold_of == 2)
        table = lm.score(source, fold_of != 2, fold_of == 2, max_bytes=-1)
        assert sorted(sent.collect(), key=str) == sorted(table.collect(), key=str)


def test_edges(edges, docs):
    got = scored(edges)
    check([(r.doc_id, r.text) for r in edges.collect()], got)
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1
    assert scored(docs([])) == {}
    fold_of = fold(F.col("doc_id"), 7)
    none = lm.score(edges, F.lit(False), fold_of == 2).collect()
    assert len(none) == 7 and all(r.n_known == 0 and r.train_tokens == 0 for r in none)
