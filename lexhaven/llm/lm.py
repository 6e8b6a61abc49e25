"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are summed over the training texts. Pairs go into a filter that
holds each once per level of its quantised count, 1 + floor(log_b count); a count is read back by
probing level after level until one is absent (Talbot and Osborne, 2007). What the probes give is
smoothed by absolute discounting: of a pair's count a discount, known from the counts of counts, is
taken off, and what that leaves, discount * different followers / count of the first word, goes to
words by their own share.

The model lies in segments. A light word's count, its number of followers and its pairs are all in
one segment; a word with at least a share of 1 / `HEAVY` of all tokens, of which there are `HEAVY`
at most, goes to every task, and its pairs to as many segments as it has shares of one. So no
segment outgrows the others, and all have about `SEGMENT_TOKENS` tokens at any size of the corpus.

Texts are scored in blocks of a few megabytes. A block asks each segment for its different words
and pairs and gets counts and levels in the order asked, with no keys. A model of at most
`max_bytes` is sent to all tasks, which answer for themselves; a larger one stays a table that the
questions meet by segment in a shuffle. Both ways ask and answer by the same functions and give the
same scores. Keys travel sorted, as differences, in bytes of equal place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaven.llm.common import batches_of, mix, mix_one, signed, words_of, work_folder, written

# The end of a text as a word; no hash of a word is expected there.
END = mix_one(0xE0F)
HEAVY = 1 << 17
LOG_BASE = 1.5
PROBES = 3
BITS_PER_ENTRY = 12
TOP_LEVEL = 64
LEAST_SEGMENTS, SEGMENT_TOKENS = 8, 1 << 21
BLOCK_BYTES = 1 << 23
# Bytes of a model that is sent to all tasks.
MAX_BYTES = 1 << 24


def first_words(hashes: np.ndarray) -> np.ndarray:
    """The 32 bits that stand for a word as the first of a pair."""
    return mix(hashes) >> np.uint64(32)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with the end after each text, and the place of each text's first."""
    hashes, first = words_of(texts)
    n = len(first) - 1
    return np.insert(hashes, first[1:], np.uint64(END)), first + np.arange(n + 1)


def befores(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word, the end before a text's first."""
    before = np.concatenate([[np.uint64(END)], words])[: len(words)]
    before[first[:-1]] = np.uint64(END)
    return before


def pairs_of(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Key of each word with the one before: 32 bits of the first word, 32 of both."""
    before = befores(words, first)
    both = mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + words)
    return (first_words(before) << np.uint64(32)) | (both >> np.uint64(32))


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits with their high bytes, mostly zero, together, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view("<u8").astype(np.uint64)


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def unstepped(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data), dtype=np.uint64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sum of the counts of each."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every, n = every[order], np.concatenate(counts).astype(np.int64)[order]
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]]))
    return every[begins], np.add.reduceat(n, begins) if len(begins) else n


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is among the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


class Heavy(NamedTuple):
    """Frequent words, the end always among them, and how segments are dealt."""

    keys: np.ndarray
    counts: np.ndarray
    firsts: np.ndarray  # sorted, apart from the keys
    parts: np.ndarray  # segments over which the pairs of each first word lie
    segments: int

    def segment_of_words(self, words: np.ndarray) -> np.ndarray:
        return (first_words(words) & np.uint64(self.segments - 1)).astype(np.int64)

    def segment_of_pairs(self, keys: np.ndarray) -> np.ndarray:
        first = keys >> np.uint64(32)
        place, is_heavy = find(self.firsts, first)
        parts = np.where(is_heavy, self.parts[place], np.uint64(1))
        return ((first + (keys & np.uint64(0xFFFFFFFF)) % parts) & np.uint64(self.segments - 1)).astype(np.int64)


def heavy_of(words: DataFrame, total: int) -> Heavy:
    """At most HEAVY words can each have a share of 1 / HEAVY of all tokens."""
    least = max(1, -(-total // HEAVY))
    found = {r["key"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in words.where(F.col("n") >= least).collect()}
    if END not in found:
        ends = words.where(F.col("key") == int(signed(np.array([END], np.uint64))[0])).first()
        found[END] = ends["n"] if ends is not None else 0
    keys = np.array(sorted(found), np.uint64)
    counts = np.array([found[k] for k in keys.tolist()], np.int64)
    segments = 1 << (max(LEAST_SEGMENTS, total // SEGMENT_TOKENS) - 1).bit_length()
    firsts, shared = summed([first_words(keys)], [counts])
    parts = np.clip(-(-shared * segments // max(1, total)), 1, segments).astype(np.uint64)
    return Heavy(keys, counts, firsts, parts, segments)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Exact counts of all words by hash: `(key, n)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Summed over several megabytes before rows are made, with bounded memory.
        for batch in batches:
            for part in batches_of(batch, limit=BLOCK_BYTES):
                found, counts = np.unique(tokens_of(part.column("text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(counts.astype(np.int64))], ["key", "n"])

    rows = df.select(df[text].alias("text")).mapInArrow(run, "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def by_segment(segment: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by segment that keeps the order within it, and each segment with its begin and end there."""
    order = np.argsort(segment, kind="stable")
    own = segment[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]).tolist() if len(own) else []
    return order, [(int(own[a]), a, z) for a, z in zip(edges[:-1], edges[1:], strict=True)]


COUNTED = "segment long, size byte, keys binary, counts binary"


def _counted(size: int, keys: np.ndarray, counts: np.ndarray, segment: np.ndarray) -> pa.RecordBatch:
    order, cuts = by_segment(segment)
    keys, counts = keys[order], counts[order]
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, _, _ in cuts], pa.int64()), pa.array(np.full(len(cuts), size, np.int8)),
         pa.array([steps(keys[a:z]) for _, a, z in cuts], pa.binary()),
         pa.array([squeezed(counts[a:z]) for _, a, z in cuts], pa.binary())],
        ["segment", "size", "keys", "counts"],
    )


def counted(df: DataFrame, light: DataFrame, heavy, text: str = "text") -> DataFrame:
    """Light words (`size` 1) and pairs (2) with counts, packed by segment; `heavy` is a broadcast."""

    def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, limit=BLOCK_BYTES):
                keys, counts = np.unique(pairs_of(*tokens_of(part.column("text"))), return_counts=True)
                yield _counted(2, keys, counts, heavy.value.segment_of_pairs(keys))

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            if n and (batch is None or n >= 1 << 20):
                keys, counts = summed([b.column("key").to_numpy().view(np.uint64) for b in held], [b.column("n").to_numpy() for b in held])
                yield _counted(1, keys, counts, heavy.value.segment_of_words(keys))
                held, n = [], 0

    pairs = df.select(df[text].alias("text")).mapInArrow(pair_rows, COUNTED)
    return pairs.union(light.select("key", "n").mapInArrow(word_rows, COUNTED))


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts, from 1."""
    return np.minimum(TOP_LEVEL, 1 + np.floor(np.log(counts) / np.log(LOG_BASE) + 1e-9)).astype(np.int64)


def middle_of(level: np.ndarray) -> np.ndarray:
    """The middle of what a level stands for; the first is one."""
    return np.where(level > 1, LOG_BASE ** (level.astype(np.float64) - 1) * (1 + LOG_BASE) / 2, level)


def _places(keys: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    """Bits of each key at a level, one array for each probe."""
    base = mix(keys ^ np.uint64(mix_one(level * 0xA24BAED4963EE407)))
    step = (base >> np.uint64(33)) | np.uint64(1)
    return [(base + np.uint64(k) * step) % np.uint64(bits) for k in range(PROBES)]


def filter_of(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of a segment's pairs: all are held, in the bits that their levels need."""
    top = levels(counts)
    bits = max(64, -(-int(top.sum()) * BITS_PER_ENTRY // 64) * 64)
    held = np.zeros(bits, bool)
    for j in range(1, int(top.max(initial=0)) + 1):
        for place in _places(keys[top >= j], j, bits):
            held[place.astype(np.int64)] = True
    return np.packbits(held, bitorder="little").tobytes()


def levels_in(data: bytes, keys: np.ndarray) -> np.ndarray:
    """Levels of keys by a filter; zero where the first is absent."""
    level = np.zeros(len(keys), np.uint8)
    left = np.arange(len(keys))
    held = np.frombuffer(data, np.uint8)
    for j in range(1, TOP_LEVEL + 1):
        present = np.ones(len(left), bool)
        for place in _places(keys[left], j, len(held) * 8):
            present &= (held[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        left = left[present]
        if not len(left):
            break
        level[left] = j
    return level


MODEL = (
    "segment long, words binary, counts binary, followers binary, filter binary, once long, twice long, "
    "heavy_first array<long>, heavy_followers array<long>"
)


def _model_row(segment: int, held: dict[int, tuple[list, list]]) -> pa.RecordBatch:
    words, counts = summed(*held[1])
    keys, n = summed(*held[2])
    first, followers = np.unique(keys >> np.uint64(32), return_counts=True)
    place, is_held = find(first, first_words(words))
    own = np.where(is_held, followers[place] if len(first) else 0, 0)
    is_light = np.isin(first, first_words(words))
    return pa.RecordBatch.from_pylist(
        [{
            "segment": segment, "words": steps(words), "counts": squeezed(counts), "followers": squeezed(own),
            "filter": filter_of(keys, n), "once": int((n == 1).sum()), "twice": int((n == 2).sum()),
            "heavy_first": signed(first[~is_light]).tolist(), "heavy_followers": followers[~is_light].tolist(),
        }],
        pa.schema([
            ("segment", pa.int64()), *((c, pa.binary()) for c in ("words", "counts", "followers", "filter")),
            ("once", pa.int64()), ("twice", pa.int64()),
            ("heavy_first", pa.list_(pa.int64())), ("heavy_followers", pa.list_(pa.int64())),
        ]),
    )


def model_rows(rows: DataFrame, segments: int) -> DataFrame:
    """The model from what `counted` gives, a row for each segment that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] != now:
                    if now is not None:
                        yield _model_row(now, held)
                    now, held = row["segment"], {1: ([], []), 2: ([], [])}
                keys, counts = held[row["size"]]
                keys.append(unstepped(row["keys"]))
                counts.append(unsqueezed(row["counts"]).astype(np.int64))
        if now is not None:
            yield _model_row(now, held)

    return rows.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(run, MODEL)


class Segment:
    """A segment of the model as it is asked."""

    def __init__(self, row: dict | None):
        self.filter = row["filter"] if row else bytes(8)
        self.words = unstepped(row["words"]) if row else np.zeros(0, np.uint64)
        self.counts = unsqueezed(row["counts"]) if row else self.words
        self.followers = unsqueezed(row["followers"]) if row else self.words

    def answer(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and followers of words, levels of pairs."""
        place, is_held = find(self.words, words)
        if not len(self.words):
            return np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64), levels_in(self.filter, pairs)
        return (
            np.where(is_held, self.counts[place], np.uint64(0)), np.where(is_held, self.followers[place], np.uint64(0)),
            levels_in(self.filter, pairs),
        )


class Questions:
    """What a block of texts asks: its different light words and pairs, by segment and key."""

    def __init__(self, texts: pa.Array, heavy: Heavy):
        self.words, self.first = tokens_of(texts)
        self.distinct, self.back = np.unique(self.words, return_inverse=True)
        self.heavy_place, self.is_heavy = find(heavy.keys, self.distinct)
        self.light = self.distinct[~self.is_heavy]
        self.pairs, self.pair_back = np.unique(pairs_of(self.words, self.first), return_inverse=True)
        self.word_order, word_cuts = by_segment(heavy.segment_of_words(self.light))
        self.pair_order, pair_cuts = by_segment(heavy.segment_of_pairs(self.pairs))
        words, pairs = self.light[self.word_order], self.pairs[self.pair_order]
        word_at = {s: words[a:z] for s, a, z in word_cuts}
        pair_at = {s: pairs[a:z] for s, a, z in pair_cuts}
        none = np.zeros(0, np.uint64)
        # Ordered by segment.
        self.asked = [(s, word_at.get(s, none), pair_at.get(s, none)) for s in sorted(word_at.keys() | pair_at.keys())]

    def put(self, answers: list[tuple[np.ndarray, np.ndarray, np.ndarray]], heavy: Heavy, heavy_followers: np.ndarray) -> tuple:
        """Counts and followers of each token, counts of each token's pair, from answers in the order asked."""
        counts, followers = (np.zeros(len(self.distinct), np.int64) for _ in range(2))
        counts[self.is_heavy] = heavy.counts[self.heavy_place[self.is_heavy]]
        followers[self.is_heavy] = heavy_followers[self.heavy_place[self.is_heavy]]
        at = np.flatnonzero(~self.is_heavy)[self.word_order]
        counts[at] = np.concatenate([a[0] for a in answers]).astype(np.int64)
        followers[at] = np.concatenate([a[1] for a in answers]).astype(np.int64)
        level = np.zeros(len(self.pairs), np.uint8)
        level[self.pair_order] = np.concatenate([a[2] for a in answers])
        return counts[self.back], followers[self.back], middle_of(level)[self.pair_back]


def in_blocks(source: DataFrame) -> DataFrame:
    """`(block, data)`: a few megabytes of rows of `key`, `text` and `held_out` as one compressed value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, limit=BLOCK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    # Copied, as what is written of a slice may be all of its buffers.
                    out.write_batch(part.take(pa.array(np.arange(part.num_rows))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"]
                )

    return source.mapInArrow(run, "block long, data binary")


def unblocked(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


def asked(blocks: DataFrame, heavy) -> DataFrame:
    """Questions of each block to each segment: `(segment, block, words, pairs)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                rows = Questions(unblocked(data.as_buffer()).column("text"), heavy.value).asked
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _, _ in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()),
                     pa.array([steps(w) for _, w, _ in rows], pa.binary()), pa.array([steps(p) for _, _, p in rows], pa.binary())],
                    ["segment", "block", "words", "pairs"],
                )

    return blocks.mapInArrow(run, "segment long, block long, words binary, pairs binary")


def answered(asking: DataFrame, model: DataFrame, segments: int) -> DataFrame:
    """Answers to each block in the order asked: `(block, segment, counts, followers, levels)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, Segment(None)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["segment"] != now:
                    # The model's row comes before what is asked of it; without entries it has none.
                    now, own = row["segment"], Segment(row if row["block"] is None else None)
                if row["block"] is None:
                    continue
                counts, followers, level = own.answer(unstepped(row["words"]), unstepped(row["pairs"]))
                out.append((row["block"], now, squeezed(counts), squeezed(followers), pa.compress(level.tobytes(), "zstd", asbytes=True)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), [pa.int64()] * 2 + [pa.binary()] * 3, strict=True)],
                    ["block", "segment", "counts", "followers", "levels"],
                )

    none = F.lit(None)
    rows = model.select("segment", none.cast("long").alias("block"), "words", none.cast("binary").alias("pairs"), "counts", "followers", "filter").union(
        asking.select("segment", "block", "words", "pairs", *[none.cast("binary")] * 3)
    )
    dealt = rows.repartition(segments, "segment").sortWithinPartitions("segment", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(run, "block long, segment long, counts binary, followers binary, levels binary")


def score(
    df: DataFrame, train: Column, held_out: Column, text: str = "text", key: str = "doc_id",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `train` marks the rows to learn from. NULL and empty texts have one token, the end; a very long
    text is a block of its own. Each row is scored by its own text: rows that repeat a key, or have
    none, are rows of their own, and equal texts have equal scores. Other columns take no part. Of
    an empty table or without training rows no count is known, and of an empty table no row is given.
    """
    spark = df.sparkSession
    work = work_folder(spark)
    training = df.where(train)
    words = written(word_counts(training, text), f"{work}/words")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(totals["n"]), int(totals["v"])
    own = heavy_of(words, total)
    heavy = spark.sparkContext.broadcast(own)
    end_key = int(signed(np.array([END], np.uint64))[0])
    light = words.where((F.col("n") < max(1, -(-total // HEAVY))) & (F.col("key") != end_key))
    model = written(model_rows(counted(training, light, heavy, text), own.segments), f"{work}/model")
    seen = model.agg(
        F.coalesce(F.sum("once"), F.lit(0)).alias("once"), F.coalesce(F.sum("twice"), F.lit(0)).alias("twice"),
        F.coalesce(F.sum(sum(F.octet_length(c) for c in ("words", "counts", "followers", "filter"))), F.lit(0)).alias("bytes"),
    ).first()
    discount = seen["once"] / (seen["once"] + 2 * seen["twice"]) if seen["once"] > 0 else 0.5
    # At most one row for each heavy word.
    each = model.select(F.explode(F.arrays_zip("heavy_first", "heavy_followers")).alias("x")).select("x.*")
    found = each.groupBy("heavy_first").agg(F.sum("heavy_followers").alias("n")).collect()
    by_first = {r["heavy_first"]: r["n"] for r in found}
    heavy_followers = np.array([by_first.get(f, 0) for f in first_words(own.keys).tolist()], np.int64)
    parts = ["segment", "words", "counts", "followers", "filter"]
    # Bounded by max_bytes, which was just compared.
    sent = [r.asDict() for r in model.select(parts).collect()] if seen["bytes"] <= max_bytes else None
    small = spark.sparkContext.broadcast((heavy_followers, sent))
    floor = float(np.log10(total + distinct + 1))

    source = df.select(df[key].alias("key"), df[text].alias("text"), held_out.alias("held_out"))
    key_type = source.schema["key"].dataType.simpleString()

    def scored(part: pa.RecordBatch, asks: Questions, answers: list) -> pa.RecordBatch:
        followers_of_heavy, _ = small.value
        c, followers, both = asks.put(answers, heavy.value, followers_of_heavy)
        begins = asks.first[:-1]
        end = int(np.searchsorted(heavy.value.keys, np.uint64(END)))

        def before(values: np.ndarray, at_begin: int) -> np.ndarray:
            out = np.concatenate([[at_begin], values])[: len(values)]
            out[begins] = at_begin
            return out

        history = before(c, heavy.value.counts[end])
        left = before(followers, followers_of_heavy[end])
        of = np.maximum(history, 1.0)
        rest = np.where(history > 0, np.clip(discount * left / of, 0.05, 1.0), 1.0)
        both = np.minimum(both, np.minimum(c, history))
        share = (c + 1.0) / (total + distinct + 1.0)
        logs = np.log10(np.maximum(both - discount, 0.0) / of + rest * share)
        return pa.RecordBatch.from_arrays(
            [
                part.column("key"), part.column("held_out"), pa.array(np.diff(asks.first).astype(np.int64)),
                pa.array(np.add.reduceat((c > 0).astype(np.int64), begins)),
                pa.array(np.full(part.num_rows, total, np.int64)),
                pa.array(np.add.reduceat(np.log10(c + 1.0) - floor, begins)),
                pa.array(np.minimum(0.0, np.add.reduceat(logs, begins))),
            ],
            ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def by_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {row["segment"]: Segment(row) for row in small.value[1]}
        none = Segment(None)
        for batch in batches:
            for part in batches_of(batch):
                asks = Questions(part.column("text"), heavy.value)
                yield scored(part, asks, [held.get(s, none).answer(w, p) for s, w, p in asks.asked])

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = []
        for batch in batches:
            data = batch.column("data")
            for at, row in enumerate(batch.select(["counts", "followers", "levels"]).to_pylist()):
                if not data[at].is_valid:
                    # Answers come before their block, by segment.
                    answers.append(row)
                    continue
                part = unblocked(data[at].as_buffer())
                asks = Questions(part.column("text"), heavy.value)
                got = [
                    (unsqueezed(r["counts"]), unsqueezed(r["followers"]),
                     np.frombuffer(pa.decompress(r["levels"], len(p), "zstd", asbytes=True), np.uint8))
                    for r, (_, _, p) in zip(answers, asks.asked, strict=True)
                ]
                yield scored(part, asks, got)
                answers = []

    made = f"key {key_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if sent is not None:
        out = source.mapInArrow(by_sent, made)
    else:
        blocks = written(in_blocks(source), f"{work}/blocks")
        answers = answered(asked(blocks, heavy), model, own.segments)
        none = F.lit(None)
        rows = answers.select("block", "segment", "counts", "followers", "levels", none.cast("binary").alias("data")).union(
            blocks.select("block", none.cast("long"), *[none.cast("binary")] * 3, "data")
        )
        out = rows.repartition(own.segments, "block").sortWithinPartitions("block", F.col("segment").asc_nulls_last()).mapInArrow(by_block, made)
    return out.withColumnRenamed("key", key)
