"""Toxic texts by a support vector machine on a string subsequence kernel.

The kernel compares two words by the three-letter subsequences they share, each weighed by
`DECAY` to the length it spans, so letters may be put between or left out (Lodhi et al., 2002).
Words are lower-cased and freed of marks and digits; their beginning counts as a letter; runs of
single letters are joined. Landmarks, chosen among the words that tell toxic texts from others,
give a Nystroem map, and the machine is linear on it. As the map is linear in the subsequences,
a word's margin is a sum over its own, looked up in one table, whatever the number of landmarks.

A sentence is as toxic as its worst word and a text as its worst sentence: labels are of texts,
so in training the words that stand for a toxic text are chosen again by the machine itself
(multiple-instance learning). A logistic curve makes the margin a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaven.llm.common import WORD, batches_of, hash_words, text_buffer, word_bounds

DECAY = 0.6
# Letters of 'beginning', a-z, and other letters by their last byte.
LETTERS = 40
# Longer words are read in overlapping parts, each as long as this.
PART = 16
# Letters a subsequence may span.
SPAN = 10
LANDMARKS = 160
# Labelled rows to learn from, at most, of each label.
SAMPLE = 2000
ROUNDS = 3
REMEMBERED = 300_000

_DELETE = bytes(b for b in range(256) if not (97 <= b <= 122 or 128 <= b < 192))
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:192] = 27 + np.arange(64) % 13


def letters(word: bytes) -> bytes:
    """Lower-case letters of a word; of a letter in several bytes the last."""
    return word.lower().translate(None, _DELETE)


@lru_cache(maxsize=64)
def _triples(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and weights of the subsequences of three letters of a word of `size`."""
    out = [
        (i, j, k, DECAY ** (k - i + 1))
        for i in range(size) for j in range(i + 1, size) for k in range(j + 1, min(size, i + SPAN))
    ]
    i, j, k, weight = zip(*out, strict=True) if out else ([], [], [], [])
    return np.array(i, np.int64), np.array(j, np.int64), np.array(k, np.int64), np.array(weight, np.float64)


def features(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Subsequence codes and weights of words of equal length, each of norm one."""
    size = len(words[0]) + 1
    codes = np.zeros((len(words), size), np.int64)
    if size > 1:
        codes[:, 1:] = _CODE[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
    i, j, k, weight = _triples(size)
    triple = (codes[:, i] * LETTERS + codes[:, j]) * LETTERS + codes[:, k]
    order = np.argsort(triple, axis=1, kind="stable")
    triple, weights = np.take_along_axis(triple, order, 1), weight[order]
    return triple, weights


def norms(triple: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of each word's kernel with itself."""
    if not triple.shape[1]:
        return np.ones(len(triple))
    new = np.ones(triple.shape, bool)
    new[:, 1:] = triple[:, 1:] != triple[:, :-1]
    flat = np.add.reduceat(weights.reshape(-1), np.flatnonzero(new.reshape(-1)))
    owner = np.repeat(np.arange(len(triple)), new.sum(axis=1))
    return np.sqrt(np.bincount(owner, flat * flat, len(triple)))


def vectors(words: list[bytes]) -> np.ndarray:
    """Words as normed rows over all subsequences; for a few words only."""
    out = np.zeros((len(words), LETTERS**3), np.float32)
    for n, word in enumerate(words):
        triple, weights = features([word])
        np.add.at(out[n], triple[0], weights[0] / norms(triple, weights)[0])
    return out


def margins(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """Sum over each word's subsequences of the table's entries; long words by their worst part."""
    out = np.full(len(words), -np.inf)
    by_size: dict[int, tuple[list[int], list[bytes]]] = {}
    for n, word in enumerate(words):
        parts = [word] if len(word) <= PART else [
            word[at : at + PART] for at in [*range(0, len(word) - PART, PART // 2), len(word) - PART]
        ]
        for part in parts:
            places, own = by_size.setdefault(len(part), ([], []))
            places.append(n)
            own.append(part)
    for size, (places, own) in by_size.items():
        step = max(1, 1_000_000 // max(1, len(_triples(size + 1)[0])))
        for at in range(0, len(own), step):
            triple, weights = features(own[at : at + step])
            value = (table[triple] * weights).sum(axis=1) / norms(triple, weights)
            np.maximum.at(out, places[at : at + step], value)
    return out


def spelled(text: bytes) -> list[bytes]:
    """Words made of runs of three or more single letters."""
    return [letters(m) for m in _SPELLED.findall(b" " + text.lower() + b" ")]


_SPELLED = re.compile(rb"(?<=[ \t-\r])(?:[a-z][.\-_*]?[ \t-\r]+){2,}[a-z](?=[.,!?;:]?[ \t-\r])")


class Model:
    """What scoring needs: a number for each subsequence, and the logistic curve."""

    def __init__(self, table: np.ndarray, offset: float, slope: float, shift: float):
        self.table, self.offset, self.slope, self.shift = table, offset, slope, shift

    def probability(self, worst: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * worst + self.shift, -30, 30)
        return 1 / (1 + np.exp(-z))


def _words(text: str) -> set[bytes]:
    raw = text.encode()
    return {letters(w) for w in re.findall(WORD.encode(), raw)} | set(spelled(raw)) | {b""}


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-5) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton's steps on its support vectors."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(50):
        short = y * (x @ w) < 1
        own, c = x[short], weight[short][:, None]
        step = np.linalg.solve(reg * np.eye(len(w)) + own.T @ (c * own), own.T @ (c[:, 0] * y[short]))
        if abs(step - w).max() < 1e-7:
            break
        w = step
    return w[:-1], float(w[-1])


def fit(texts: list[str], labels: list[int], clean_weight: float = 1.0) -> Model:
    """Learn from labelled texts, those without the label standing for so many of their kind.

    Without both labels every score is the share of toxic ones."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(LETTERS**3, np.float32), 0.0, 0.0, math.log((p + 1e-3) / (1 - p + 1e-3)))
    bags = [_words(t or "") for t in texts]
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    in_toxic = Counter(w for bag, label in zip(bags, labels, strict=True) if label for w in bag)
    in_clean = Counter(w for bag, label in zip(bags, labels, strict=True) if not label for w in bag)
    # Parts of words that tell toxic texts from others, to begin with.
    toxic, clean = Counter(), Counter()
    for w, n in in_toxic.items():
        for g in _grams(w):
            toxic[g] += n
    for w, n in in_clean.items():
        for g in _grams(w):
            if g in toxic:
                clean[g] += n
    # Of the number of toxic texts with a part, what chance leaves in doubt is taken off.
    gain = {
        g: math.log((max(0.0, c - 3.0 * math.sqrt(c)) + 0.5) / (n1 + 1)) - math.log((clean[g] + 0.5) / (n0 + 1))
        for g, c in toxic.items() if c >= max(3, n1 // 200)
    }
    first = {w: max((gain.get(g, 0.0) for g in _grams(w)), default=0.0) for w in in_toxic.keys() | in_clean.keys()}
    # Words worth a look, and of each text without the label a few others.
    looked_at = {w for w, v in first.items() if v > 0.5} | {b""}
    others = Counter(dict.fromkeys((w for w, _ in in_clean.most_common(1500) if in_clean[w] / n0 >= 0.5 * in_toxic[w] / n1), 10))
    for bag, label in zip(bags, labels, strict=True):
        if not label:
            others.update(sorted(bag, key=hash_of)[:3])
    bags = [(bag & looked_at) or {b""} for bag in bags]
    words = sorted(looked_at | others.keys())
    index = {w: i for i, w in enumerate(words)}
    value = np.array([first.get(w, 0.0) for w in words])
    table, offset = np.zeros(LETTERS**3, np.float32), 0.0
    # The words that stand for toxic texts: near the most telling one of each.
    positive = Counter()
    for bag, label in zip(bags, labels, strict=True):
        top = max(first.get(w, 0.0) for w in bag)
        if label and top > 1.5:
            positive.update(w for w in bag if first.get(w, 0.0) > max(1.5, 0.6 * top))
    for w in [w for w in positive if in_clean[w] / n0 >= 0.2 * in_toxic[w] / n1]:
        positive.pop(w)
    for _ in range(ROUNDS if positive else 0):
        # Of texts without the label, the words that seem worst so far.
        negative = Counter(others)
        for bag, label in zip(bags, labels, strict=True):
            if not label:
                negative.update({w: 3 for w in sorted(bag, key=lambda w: -value[index[w]])[:3]})
        bad, good = [w for w, _ in positive.most_common(1000)], [w for w, _ in negative.most_common(3000)]
        # Known words with a letter put in between, so that the machine allows for it.
        bent = [(w[:i] + bytes([97 + (7 * i + len(w)) % 26]) + w[i:], positive[w] / len(w)) for w in bad[:200] for i in range(2, len(w) - 1)]
        marks = bad[: 2 * LANDMARKS // 3]
        base = vectors(list(dict.fromkeys(marks + good[: LANDMARKS - len(marks)])))
        value, turn = np.linalg.eigh((base @ base.T).astype(np.float64))
        root = turn / np.sqrt(np.maximum(value, 1e-3)) @ turn.T
        rows = bad + [w for w, _ in bent] + good
        x = np.vstack([vectors(rows[at : at + 256]) @ base.T for at in range(0, len(rows), 256)]) @ root
        label = np.array([1.0] * (len(bad) + len(bent)) + [-1.0] * len(good))
        weight = np.array([float(positive[w]) for w in bad] + [n for _, n in bent] + [float(negative[w]) for w in good])
        weight = np.where(label > 0, weight / weight[label > 0].sum(), weight / weight[label < 0].sum()) * len(weight)
        w, offset = _machine(x, label, weight)
        table = (base.T @ (root @ w)).astype(np.float32)
        value = margins(words, table) + offset
    worst = [max(bag, key=lambda w: (value[index[w]], w)) for bag in bags]
    top = margins(worst, table) + offset
    slope, shift = _logistic(top, y, np.where(y == 1, 1.0, clean_weight))
    return Model(table, offset, slope, shift)


def _grams(word: bytes) -> set[bytes]:
    marked = b"^" + word + b"$"
    return {marked[i : i + n] for n in (4, 6) for i in range(len(marked) - n + 1)}


def hash_of(word: bytes) -> int:
    return int.from_bytes(word[:8].ljust(8, b"\0"), "big") * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's steps, halved until the loss falls; targets are drawn in a little, so both stay finite."""
    t = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    rows = np.column_stack([x, np.ones(len(x))])

    def loss(v: np.ndarray) -> float:
        z = rows @ v
        return float((weight * (np.logaddexp(0, z) - t * z)).sum() + 5e-4 * v[0] ** 2)

    v = np.array([1.0, -float(np.median(x))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ v, -30, 30)))
        slope = rows.T @ (weight * (p - t)) + np.array([1e-3 * v[0], 0.0])
        curve = rows.T @ (rows * (weight * (p * (1 - p) + 1e-9))[:, None]) + np.diag([1e-3, 1e-9])
        step, size, before = np.linalg.solve(curve, slope), 1.0, loss(v)
        while loss(v - size * step) > before and size > 1e-8:
            size /= 2
        v = v - size * step
        if abs(size * step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def training_rows(df: DataFrame, labels: DataFrame, train: Column, key: str, text: str, label: str, most: int):
    """Texts and labels of at most `most` keys of each label, chosen by a hash; of repeated keys the least text.

    Also how many of all rows one without the label stands for, against one with it.
    """
    given = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).where("label in (0, 1) and key is not null")
    source = df.where(train).select(df[key].alias("key"), df[text].alias("text"))
    held = given.join(source.select("key"), "key", "left_semi").groupBy("key").agg(F.max("label").alias("label"))
    chosen = [held.where(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(most) for v in (0, 1)]
    # At most 2 x `most` keys.
    picked = source.join(F.broadcast(chosen[0].union(chosen[1])), "key")
    # One row of each key, whatever the number of its rows.
    rows = picked.groupBy("key").agg(F.min("text").alias("text"), F.max("label").alias("label")).collect()
    rows.sort(key=lambda r: r["key"])
    counts = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}
    own = [sum(r["label"] == v for r in rows) for v in (0, 1)]
    weight = counts[0] / own[0] / (counts[1] / own[1]) if min(own) else 1.0
    return [r["text"] for r in rows], [r["label"] for r in rows], weight


def toxicity(
    df: DataFrame, labels: DataFrame, train: Column, held_out: Column, text: str = "text",
    key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE,
) -> DataFrame:
    """Per text: key, held_out, score from 0 to 1, predicted, and the toxic words' number.

    Learns from at most `sample` rows of each label among the rows that `train` marks. Texts
    without letters, NULL and empty ones have the score of an empty word. Repeated rows score
    alike. Without rows of both labels every text scores the share of toxic ones. Other columns
    take no part; an empty table gives no rows.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(fit(*training_rows(df, labels, train, key, text, label, sample)))
    source = df.select(df[key].alias("key"), df[text].alias("text"), held_out.alias("held_out"))
    key_type = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = model.value
        known: dict[int, float] = {}
        empty = float(margins([b""], learned.table)[0])
        for batch in batches:
            for part in batches_of(batch):
                data, offsets = text_buffer(part.column("text"))
                starts, stops, first = word_bounds(data, offsets)
                hashes, sample_at, back = np.unique(
                    hash_words(data, starts, stops), return_index=True, return_inverse=True
                )
                if len(known) > REMEMBERED:
                    known.clear()
                listed = hashes.tolist()
                new = [i for i, h in enumerate(listed) if h not in known]
                raw = data.data
                spelt = [letters(bytes(raw[starts[i] : stops[i]])) for i in sample_at[new].tolist()]
                known.update(zip([listed[i] for i in new], margins(spelt, learned.table).tolist(), strict=True))
                value = np.array([known[h] for h in listed])[back] if listed else np.zeros(0)
                n = np.diff(first)
                worst = np.full(len(n), empty)
                some = n > 0
                if some.any():
                    worst[some] = np.maximum(empty, np.maximum.reduceat(value, first[:-1][some]))
                # Runs of single letters are rare; only texts with three in a row are read for them.
                single = (stops - starts <= 2) & (data[starts] | 32 >= 97) & (data[starts] | 32 <= 122)
                three = np.flatnonzero(single[:-2] & single[1:-1] & single[2:]) if len(single) > 2 else []
                for t in np.unique(np.searchsorted(first, three, "right") - 1).tolist():
                    if found := spelled(bytes(raw[offsets[t] : offsets[t + 1]])):
                        worst[t] = max(worst[t], float(margins(found, learned.table).max()))
                score = learned.probability(worst + learned.offset)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    ["key", "held_out", "score", "predicted"],
                )

    out = source.mapInArrow(run, f"key {key_type}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("key", key)
