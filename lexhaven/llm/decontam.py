"""Benchmark passages in texts, by edit distance.

Windows of an item's length are embedded by CGK random walks over their words: the walk reads
the current word, and a random bit that depends on step and word says whether it moves on. Texts
at a small edit distance walk in step again soon after each edit, so edit distance becomes
Hamming distance, and a few sampled steps of the walk serve as an LSH key. Repetitions with other
walks and samples raise the recall to a target. Windows that share a key with an item are confirmed by
exact edit distance (Chakraborty, Goldenberg and Koucky, 2016; Zhang and Zhang, 2017).

Only windows where an item can lie within the allowed edits are embedded: e edits of an item of
n words leave n - 2 - 3 e of its runs of three words whole, so a text with fewer of them has no
window to look at, and those it has say where windows may start. Nothing is lost by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexhaven.llm.common import batches_of, combined, mix, words_of

# Edits allowed for each word of an item.
EDIT_SHARE = 0.2
RECALL = 0.99
# Steps sampled for a key, and the share of steps that agree at the allowed distance.
SAMPLES = 3
AGREEMENT = 0.55
# Characters of items that go to the tasks at a time.
BLOCK_CHARS = 1 << 25
RUN = 3


def repetitions(recall: float = RECALL) -> int:
    """Walks needed so that a window at the allowed distance shares a key with the wished chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREEMENT**SAMPLES))


def allowed(words: int, share: float = EDIT_SHARE) -> int:
    """Edits allowed for an item; at least one run of `RUN` words then stays whole.

    e edits leave words - 2 - 3 e runs of three at least.
    """
    return max(0, min(int(share * words), (words - RUN) // RUN))


@lru_cache(maxsize=100_000)
def sampled_steps(words: int, repetition: int) -> list[int]:
    """Steps of the walk taken into the key; the first two thirds of the 3 n steps hold most text."""
    made = mix(np.arange(64, dtype=np.uint64) + np.uint64(1000 * repetition + 7 * words + 1))
    steps = list(dict.fromkeys((made % np.uint64(max(1, 2 * words))).tolist()))
    return sorted(steps[:SAMPLES])


def keys_of(hashes: np.ndarray, starts: np.ndarray, words: np.ndarray, ends: np.ndarray, rounds: int) -> np.ndarray:
    """LSH keys, a row for each repetition, of windows of so many words, each cut at its text's end."""
    sizes, size_of = np.unique(words, return_inverse=True)
    steps = np.zeros((rounds, len(sizes), 2 * int(sizes.max(initial=1)) + 1), bool)
    for n, size in enumerate(sizes.tolist()):
        for r in range(rounds):
            steps[r, n, sampled_steps(size, r)] = True
    numbers = np.arange(rounds, dtype=np.uint64)[:, None]
    at = np.broadcast_to(starts, (rounds, len(starts))).copy()
    stop = np.minimum(starts + words, ends)
    key = words.astype(np.uint64) * np.uint64(131) + numbers
    for step in range(steps.shape[2]):
        word = np.where(at < stop, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))
        taken = steps[:, size_of, step]
        if taken.any():
            key = np.where(taken, mix(key * np.uint64(0x9E3779B97F4A7C15) + word), key)
        salt = (np.uint64(2 * step + 1) + numbers * np.uint64(2048)) * np.uint64(0xD1342543DE82EF95)
        at += (mix(word ^ salt) & np.uint64(1)).astype(np.int64)
    return key


def edits(item: list[int], text: list[int], most: int) -> int:
    """Fewest word edits that turn the item into some part of the text; most + 1 if more."""
    above = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        row = [i]
        for j, other in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (word != other)))
        if min(row) > most:
            return most + 1
        above = row
    return min(above)


class Items:
    """Items of one block, ready for lookups."""

    def __init__(self, items: list[tuple[int, str]], share: float, recall: float):
        hashes, first = words_of(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.words = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.most = [allowed(len(w), share) for w in self.words]
        self.rounds = repetitions(recall)
        uses: dict[int, list[tuple[int, int, int]]] = {}
        filled = [n for n, w in enumerate(self.words) if len(w)]
        # Items by repetition, length and key.
        self.keys: dict[tuple[int, int, int], list[int]] = {}
        if filled:
            keys = keys_of(hashes, first[filled], np.array([len(self.words[n]) for n in filled]), first[1:][filled], self.rounds)
            for r, row in enumerate(keys.tolist()):
                for n, k in zip(filled, row, strict=True):
                    self.keys.setdefault((r, len(self.words[n]), k), []).append(n)
        self.all_keys = np.array(sorted({k for _, _, k in self.keys}), np.uint64)
        for n, w in enumerate(self.words):
            if not len(w):
                continue
            width = min(RUN, len(w))
            uses.setdefault(width, []).extend((h, n, at) for at, h in enumerate(combined(w, width).tolist()))
        # By width: run hashes in order, where the uses of each begin, their items and offsets.
        self.runs = {}
        for width, found in uses.items():
            found.sort()
            hashes = np.array([h for h, _, _ in found], np.uint64)
            distinct, begin = np.unique(hashes, return_index=True)
            item, offset = np.array([(n, at) for _, n, at in found], np.int64).T
            self.runs[width] = distinct, np.append(begin, len(found)), item, offset
        self.size = np.array([len(w) for w in self.words], np.int64)
        # Different runs of an item that a text must have.
        self.needed = np.array([len({*combined(w, min(RUN, len(w))).tolist()}) - RUN * e if len(w) else 0
                                for w, e in zip(self.words, self.most, strict=True)], np.int64)

    def windows(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """Start, text and length of the windows to look at."""
        out: set[tuple[int, int, int]] = set()
        for width, (runs, begin, item, offset) in self.runs.items():
            found = combined(hashes, width)
            # Most words are ruled out by 16 bits.
            table = np.zeros(1 << 16, bool)
            table[(runs & np.uint64(0xFFFF)).astype(np.int64)] = True
            some = np.flatnonzero(table[(found & np.uint64(0xFFFF)).astype(np.int64)])
            which = np.minimum(np.searchsorted(runs, found[some]), len(runs) - 1)
            hit = runs[which] == found[some]
            places, which = some[hit], which[hit]
            text = np.searchsorted(first, places, "right") - 1
            inside = places + width <= first[text + 1]
            places, which, text = places[inside], which[inside], text[inside]
            # Every use of every run that was hit.
            times = begin[which + 1] - begin[which]
            use = np.arange(times.sum()) + np.repeat(begin[which] - (np.cumsum(times) - times), times)
            texts, items, start = np.repeat(text, times), item[use], np.repeat(places, times) - offset[use]
            # Runs, each counted once, by text and item.
            pair = texts * len(self.ids) + items
            order = np.lexsort((np.repeat(which, times), pair))
            ordered, kinds = pair[order], np.repeat(which, times)[order]
            new = np.ones(len(ordered), bool)
            new[1:] = (ordered[1:] != ordered[:-1]) | (kinds[1:] != kinds[:-1])
            pairs, counts = np.unique(ordered[new], return_counts=True)
            enough = pairs[counts >= np.maximum(1, self.needed[pairs % len(self.ids)])]
            for i in np.flatnonzero(np.isin(pair, enough)).tolist():
                t, n, s = int(texts[i]), int(items[i]), int(start[i])
                low = max(int(first[t]), s - self.most[n])
                high = min(int(first[t + 1]) - 1, s + self.most[n])
                out.update((at, t, int(self.size[n])) for at in range(low, high + 1))
        return sorted(out)

    def find(self, hashes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """By text and item: fewest edits and the place of the first word."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        windows = self.windows(hashes, first)
        met: set[tuple[int, int, int]] = set()
        for low in range(0, len(windows), 4096):
            starts, texts, words = np.array(windows[low : low + 4096], np.int64).T
            keys = keys_of(hashes, starts, words, first[texts + 1], self.rounds)
            for r, i in zip(*(found.tolist() for found in np.nonzero(np.isin(keys, self.all_keys))), strict=True):
                for n in self.keys.get((r, int(words[i]), int(keys[r, i])), ()):
                    met.add((int(texts[i]), n, int(starts[i])))
        for text, n, start in sorted(met):
            if best.get((text, n), (1,))[0] == 0:
                continue
            most, words = self.most[n], int(self.size[n])
            part = hashes[max(first[text], start - most) : min(first[text + 1], start + words + most)]
            d = edits(self.words[n].tolist(), part.tolist(), most)
            if d <= most and (d, start) < best.get((text, n), (most + 1, 0)):
                best[text, n] = (d, start)
        return {(t, n): (d, s - int(first[t])) for (t, n), (d, s) in best.items()}


def contamination(
    df: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
    item_text: str = "text", share: float = EDIT_SHARE, recall: float = RECALL,
) -> DataFrame:
    """One row per text and item found in it: keys, fewest word edits, place of the first word.

    Words are compared without regard to the case of A-Z. Items without words, NULL or empty
    texts match nothing; repeated texts and items give a row each. Other columns take no part.
    An empty table on either side gives no rows. Items go to the tasks in blocks of bounded
    size, one pass over the texts for each, so their number has no limit; a set of benchmarks
    is one block.
    """
    spark = df.sparkSession
    # Repeated rows go out once, with their number.
    wanted = (
        items.select(items[item].alias("item"), items[item_text].alias("text")).where("text is not null and item is not null")
        .groupBy("item", "text").agg(F.count("*").alias("times"))
    )
    chars = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    source = df.select(df[key].alias("key"), df[text].alias("text"))
    key_type = source.schema["key"].dataType.simpleString()
    found = None
    for block in range(blocks):
        # About BLOCK_CHARS bytes of items at most, however many texts one item has.
        rows = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast([(int(r["item"]), r["text"], r["times"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Items([(n, text) for n, (_, text, _) in enumerate(sent.value)], share, recall)
            for batch in batches:
                for part in batches_of(batch):
                    hashes, first = words_of(part.column("text"))
                    met = sorted(known.find(hashes, first).items()) if len(hashes) and known.runs else []
                    rows = [sent.value[n] for (_, n), _ in met]
                    met = [m for m, (_, _, times) in zip(met, rows, strict=True) for _ in range(times)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("key").take(pa.array([t for (t, _), _ in met], pa.int64())),
                            pa.array([sent.value[n][0] for (_, n), _ in met], pa.int64()),
                            pa.array([d for _, (d, _) in met], pa.int64()),
                            pa.array([s for _, (_, s) in met], pa.int64()),
                        ],
                        ["key", "item", "edits", "start_word"],
                    )

        one = source.mapInArrow(run, f"key {key_type}, item long, edits long, start_word long")
        found = one if found is None else found.unionAll(one)
    return found.withColumnsRenamed({"key": key, "item": item})
