"""Collocations by counting quotient filters.

Texts are coded once, block by block, each with a dictionary of its own; only the dictionaries are
counted and joined, never single occurrences. Words that occur often enough get dense numbers, and
runs of n words become n packed numbers. An invertible permutation of exactly that many bits spreads
them evenly; the leading bits are the quotient, all others the remainder, so nothing is lost and the
run can be read back. A filter holds the runs sorted, quotients as gaps, remainders in full, and
counts. Tasks send filters cut by ranges of the quotient; each range is merged on its own.

Pairs are counted first. Longer runs are counted where all their pairs may be frequent, by a bit
field of fixed size that misses no frequent pair; all counts that come out are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexhaven.llm.common import batches_of, hash_word, mix, mix_one, text_buffer, work_folder, written

# Bytes of text that share a dictionary, and bytes that a task holds for all languages.
BLOCK_BYTES = 4 << 20
HELD_BYTES = 16 << 20
# Bytes of text taken apart at once; a longer piece stands alone.
STEP_BYTES = 2 << 20
# Runs in a filter before a task sends it, and words of all texts for each range of quotients.
FILTER_RUNS = 1 << 20
RANGE_WORDS = 1 << 20
# Words a language may have that occur often enough: five numbers fit 128 bits.
MOST_BITS = 25
# Bits of the field that tells which pairs may be frequent: 8 MB, at any size of input.
FIELD_BITS = 26
ROUNDS = 4
# Parts of a language's dictionary that are numbered on their own.
NUMBERED = 256

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD_BYTE = ~_BREAK
_WORD_BYTE[[32, 9]] = False


def steps(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut texts into stretches of about `STEP_BYTES`, only at ends of pieces."""
    ends = np.union1d(np.flatnonzero(_BREAK[data]) + 1, offsets[1:])
    at = 0
    while at < len(data):
        i = int(np.searchsorted(ends, at + STEP_BYTES, "right")) - 1
        to = int(ends[i]) if i >= 0 and ends[i] > at else int(ends[np.searchsorted(ends, at, "right")])
        yield at, to
        at = to


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of a stretch, A-Z as a-z, and for each whether a new piece begins with it.

    `ends` are the places where a text ends.
    """
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = _WORD_BYTE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    places = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(
        len(first), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[inside]))
    )
    # A break before a word: a mark, or the end of a text, since the word before it.
    marks = np.concatenate([[0], np.cumsum(_BREAK[data] | edge[1:])])
    fresh = np.ones(len(first), bool)
    fresh[1:] = marks[first[1:]] != marks[last[:-1] - 1]
    return words, fresh


def narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as the largest needs."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def coded(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Blocks of one language: dictionary, counts, and the words by number from 1, 0 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        made = TaskContext.get().partitionId() << 32

        def block(name: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            parts = held.pop(name)
            del sizes[name]
            code = pa.chunked_array([w for w, _ in parts]).unify_dictionaries().combine_chunks()
            fresh = np.concatenate([f for _, f in parts])
            numbers = code.indices.to_numpy().astype(np.int64)
            stream = np.zeros(len(numbers) + int(fresh.sum()), np.int64)
            stream[np.arange(len(numbers)) + np.cumsum(fresh)] = numbers + 1
            counts = np.bincount(numbers, minlength=len(code.dictionary))
            ids = narrow(stream)
            return pa.RecordBatch.from_pydict({
                "block": pa.array([made], pa.int64()), "lang": pa.array([name], pa.string()),
                "words": pa.array([code.dictionary.cast(pa.string())], pa.list_(pa.string())),
                "counts": pa.array([counts], pa.list_(pa.int64())),
                "width": pa.array([ids.itemsize], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
            })

        for batch in batches:
            for part in batches_of(batch):
                langs = part.column("lang").dictionary_encode()
                which = langs.indices.to_numpy()
                for i, name in enumerate(langs.dictionary.to_pylist()):
                    data, offsets = text_buffer(part.column("text").take(pa.array(np.flatnonzero(which == i))))
                    for at, to in steps(data, offsets):
                        ends = offsets[(offsets > at) & (offsets <= to)] - at
                        words, fresh = words_of(data[at:to], ends)
                        if len(words):
                            held.setdefault(name, []).append((words.dictionary_encode(), fresh))
                            sizes[name] = sizes.get(name, 0) + to - at
                            if sizes[name] >= BLOCK_BYTES:
                                yield block(name)
                while sum(sizes.values()) > HELD_BYTES:
                    yield block(max(sizes, key=sizes.get))
        for name in sorted(held):
            yield block(name)
        pa.default_memory_pool().release_unused()

    source = df.select(F.coalesce(df[f"`{lang}`"], F.lit("und")).alias("lang"), df[f"`{text}`"].alias("text"))
    return source.mapInArrow(run, "block long, lang string, words array<string>, counts array<long>, width int, ids binary")


@dataclass(frozen=True)
class Shape:
    """How runs of `n` words with numbers of `bits` bits are cut: `quotient` leading bits, the rest remainder."""

    n: int
    bits: int
    quotient: int

    @classmethod
    def of(cls, n: int, bits: int, words: int) -> Shape:
        return cls(n, bits, min(words.bit_length(), n * bits, 62))

    @property
    def left(self) -> int:
        return (self.n * self.bits + 1) // 2

    @property
    def right(self) -> int:
        return self.n * self.bits // 2

    @property
    def high(self) -> int:
        """Bits in the first of the two 64-bit parts of a run."""
        return min(64, self.n * self.bits)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _round(half: np.ndarray, turn: int, salt: int) -> np.ndarray:
    return mix(half * np.uint64(0x9E3779B97F4A7C15) + np.uint64(mix_one(salt + turn + 1)))


def joined(shape: Shape, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves as one number in two parts: the leading 64 bits, or all there are, and the rest."""
    rest = shape.left + shape.right - shape.high
    up = np.uint64(shape.high - shape.left)
    return left << up | right >> np.uint64(rest), right & _mask(rest)


def parted(shape: Shape, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The halves that `joined` put together."""
    rest = shape.left + shape.right - shape.high
    inner = shape.high - shape.left
    return high >> np.uint64(inner), (high & _mask(inner)) << np.uint64(rest) | low


def permuted(shape: Shape, numbers: list[np.ndarray], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed numbers of words, one array for each place, after a Feistel permutation of all bits."""
    left = np.zeros(len(numbers[0]), np.uint64)
    right = np.zeros(len(numbers[0]), np.uint64)
    for i, word in enumerate(numbers):
        # Bits of the number fall into the halves from the last place up.
        at, word = (shape.n - 1 - i) * shape.bits, word.astype(np.uint64)
        if at >= shape.right:
            left |= word << np.uint64(at - shape.right)
        else:
            right |= word << np.uint64(at) & _mask(shape.right)
            if at + shape.bits > shape.right:
                left |= word >> np.uint64(shape.right - at)
    for turn in range(ROUNDS):
        left = left ^ _round(right, 2 * turn, salt) & _mask(shape.left)
        right = right ^ _round(left, 2 * turn + 1, salt) & _mask(shape.right)
    return joined(shape, left, right)


def restored(shape: Shape, high: np.ndarray, low: np.ndarray, salt: int) -> list[np.ndarray]:
    """The numbers of words that `permuted` hid."""
    left, right = parted(shape, high, low)
    for turn in reversed(range(ROUNDS)):
        right = right ^ _round(left, 2 * turn + 1, salt) & _mask(shape.right)
        left = left ^ _round(right, 2 * turn, salt) & _mask(shape.left)
    out = []
    for i in range(shape.n):
        at = (shape.n - 1 - i) * shape.bits
        if at >= shape.right:
            word = left >> np.uint64(at - shape.right)
        else:
            word = right >> np.uint64(at)
            if at + shape.bits > shape.right:
                word = word | left << np.uint64(shape.right - at)
        out.append(word & _mask(shape.bits))
    return out


def summed(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different runs and the sum of their counts."""
    if not len(high):
        return high, low, counts
    order = np.lexsort((low, high)) if low.any() else np.argsort(high, kind="stable")
    high, low, counts = high[order], low[order], counts[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    starts = np.flatnonzero(new)
    return high[starts], low[starts], np.add.reduceat(counts, starts)


def _squeezed(values: np.ndarray) -> list[np.ndarray]:
    """A byte for each number, 255 for those that follow in full."""
    return [np.minimum(values, np.array(255, values.dtype)).astype(np.uint8), values[values >= 255].astype(np.uint64)]


def _cut(values: np.ndarray, bits: int) -> np.ndarray:
    """The bytes that `bits` bits need, of each number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)])


def packed(shape: Shape, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> bytes:
    """A filter of sorted runs: gaps of quotients, both parts of the remainders, counts less one."""
    rest = shape.high - shape.quotient
    quotients = high >> np.uint64(rest)
    gaps, far = _squeezed(np.diff(quotients))
    few, many = _squeezed(counts - 1)
    head = np.array([len(high), int(quotients[0]), len(far), len(many)], np.uint64)
    columns = (head, far, many, gaps, few, _cut(high & _mask(rest), rest), _cut(low, shape.n * shape.bits - shape.high))
    return b"".join(c.tobytes() for c in columns)


def unpacked(shape: Shape, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted runs and counts of a filter."""
    rest, at = shape.high - shape.quotient, 0

    def taken(n: int, kind: type = np.uint8) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    def whole(n: int, bits: int) -> np.ndarray:
        size = -(-bits // 8)
        out = np.zeros((n, 8), np.uint8)
        out[:, :size] = taken(n * size).reshape(n, size)
        return out.view("<u8").reshape(-1)

    n, first, n_far, n_many = taken(4, np.uint64).tolist()
    far, many = taken(n_far, np.uint64), taken(n_many, np.uint64)
    gaps, few = taken(n - 1).astype(np.uint64), taken(n).astype(np.int64)
    gaps[gaps == 255], few[few == 255] = far, many
    quotients = np.concatenate([[np.uint64(first)], gaps]).cumsum(dtype=np.uint64)
    return quotients << np.uint64(rest) | whole(n, rest), whole(n, shape.n * shape.bits - shape.high), few + 1


def range_starts(shape: Shape, ranges: int) -> np.ndarray:
    """The first run of each range of quotients, by its leading part."""
    rest = shape.high - shape.quotient
    return np.array([-(-(r << shape.quotient) // ranges) << rest for r in range(ranges)], np.uint64)


def runs_of(stream: np.ndarray, n: int, alive: np.ndarray | None = None) -> np.ndarray:
    """Places of `n` known words in a row; `alive` says which places begin a pair worth following."""
    size = max(0, len(stream) - n + 1)
    if alive is not None:
        held = np.ones(size, bool)
        for k in range(n - 1):
            held &= alive[k : k + size]
        return np.flatnonzero(held)
    held = stream[:size] > 0
    for k in range(1, n):
        held &= stream[k : k + size] > 0
    return np.flatnonzero(held)


def field_places(first: np.ndarray, second: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """The bit of each pair of words in the field."""
    return mix((first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)) + np.uint64(salt)) >> np.uint64(64 - bits)


def counted(streams: DataFrame, shapes: list[Shape], ranges: int, least: int, field: bytes | None = None) -> DataFrame:
    """Runs of words that occur `least` times: `lang`, `ids`, `f`; of pairs also their `place` in the field.

    With `field`, only runs all of whose pairs have their bits there are counted.
    """
    by_size = {s.n: s for s in shapes}
    starts = {s.n: range_starts(s, ranges) for s in shapes}
    held_field = None if field is None else streams.sparkSession.sparkContext.broadcast(field)

    def sent(lang: str, n: int, parts: list) -> pa.RecordBatch:
        high, low, counts = summed(*(np.concatenate(c) for c in zip(*parts)))
        cuts = np.searchsorted(high, starts[n]).tolist() + [len(high)]
        rows = [(r, packed(by_size[n], high[a:b], low[a:b], counts[a:b])) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(rows), pa.string()), "n": pa.array([n] * len(rows), pa.int32()),
            "range": pa.array([r for r, _ in rows], pa.int32()), "filter": pa.array([f for _, f in rows], pa.binary()),
        })

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if held_field is None else np.frombuffer(held_field.value, np.uint8)
        held: dict[tuple[str, int], list] = {}
        sizes: dict[tuple[str, int], int] = {}
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("ids")):
                stream = np.frombuffer(data.as_buffer(), np.uint32)
                salt, alive = hash_word(lang) if lang else 1, None
                if bits is not None:
                    place = field_places(stream[:-1], stream[1:], salt, FIELD_BITS)
                    alive = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    alive &= (stream[:-1] > 0) & (stream[1:] > 0)
                for n, shape in by_size.items():
                    at = runs_of(stream, n, alive)
                    if not len(at):
                        continue
                    numbers = [stream[at + k] for k in range(n)]
                    if n * shape.bits <= 64:
                        whole = numbers[0].astype(np.uint64)
                        for word in numbers[1:]:
                            whole = whole << np.uint64(shape.bits) | word
                        whole, counts = np.unique(whole, return_counts=True)
                        numbers = [whole >> np.uint64(shape.bits * (n - 1 - k)) & _mask(shape.bits) for k in range(n)]
                    else:
                        counts = np.ones(len(at), np.int64)
                    entry = summed(*permuted(shape, numbers, salt), counts)
                    held.setdefault((lang, n), []).append(entry)
                    sizes[lang, n] = sizes.get((lang, n), 0) + len(entry[0])
                while sum(sizes.values()) > FILTER_RUNS:
                    largest = max(sizes, key=sizes.get)
                    del sizes[largest]
                    yield sent(*largest, held.pop(largest))
        for key in sorted(held):
            yield sent(*key, held.pop(key))
        pa.default_memory_pool().release_unused()

    def merge(table: pa.Table) -> pa.Table:
        lang, n = table.column("lang")[0].as_py(), table.column("n")[0].as_py()
        shape, salt = by_size[n], hash_word(lang) if lang else 1
        filters = [unpacked(shape, f.as_buffer()) for f in table.column("filter")]
        high, low, counts = summed(*(np.concatenate(c) for c in zip(*filters)))
        often = counts >= least
        numbers = restored(shape, high[often], low[often], salt)
        flat = np.stack(numbers, 1).astype(np.int32) if often.any() else np.zeros((0, n), np.int32)
        places = field_places(*numbers, salt, FIELD_BITS).astype(np.int64) if n == 2 else np.full(len(flat), -1)
        return pa.Table.from_pydict({
            "lang": pa.array([lang] * len(flat), pa.string()),
            "ids": pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * n, pa.int32()), pa.array(flat.reshape(-1), pa.int32())),
            "f": pa.array(counts[often], pa.int64()), "place": pa.array(places, pa.int64()),
        })

    filters = streams.select("lang", "ids").mapInArrow(build, "lang string, n int, range int, filter binary")
    return filters.groupBy("n", "range", "lang").applyInArrow(merge, "lang string, ids array<int>, f long, place long")


def field_of(pairs: DataFrame) -> bytes:
    """A bit for every frequent pair, in a field of fixed size; at most a row for 64 bits is collected."""
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    table = pairs.groupBy(F.shiftright("place", 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << FIELD_BITS - 6, np.int64)
    out[table.column("cell").to_numpy()] = table.column("bits").to_numpy()
    return out.tobytes()


def dictionary_of(blocks: DataFrame, least: int, work: str) -> tuple[DataFrame, DataFrame]:
    """Words that occur `least` times with a number from 1 in their language; and all words by language."""
    words = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    every = words.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    part = F.pmod(F.xxhash64("word"), F.lit(NUMBERED)).alias("part")
    held = written(every.where(F.col("f") >= least).select("lang", "word", "f", part), f"{work}/words")
    totals = blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    totals = written(totals.groupBy("lang").agg(F.sum("n").alias("n")), f"{work}/totals")
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("lang", "part").agg(F.count("*").alias("n")).select("lang", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("lang", "part").orderBy("word"))
    numbered = held.withColumn("inner", inner).join(starts, ["lang", "part"])
    return written(numbered.select("lang", "word", "f", (F.col("before") + F.col("inner")).cast("int").alias("id")), f"{work}/dictionary"), totals


def streams_of(blocks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Blocks with the numbers of the dictionary, 0 for other words and between pieces."""
    # Rare words stay in the join, which so grows with the dictionaries and not with the share of
    # words that are frequent; they are left out of the lists.
    found = F.col("id").isNotNull()
    known = (
        blocks.select("block", "lang", F.posexplode("words").alias("pos", "word"))
        .join(dictionary.select("lang", "word", "id").hint("merge"), ["lang", "word"], "left")
        .groupBy("block").agg(F.collect_list(F.when(found, F.col("pos"))).alias("pos"), F.collect_list("id").alias("id"))
    )
    both = blocks.select("block", "lang", F.size("words").alias("size"), "width", "ids").join(known, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = {n: batch.column(n)[row] for n in ("lang", "size", "width", "ids", "pos", "id")}
                numbers = np.zeros(value["size"].as_py() + 1, np.uint32)
                numbers[value["pos"].values.to_numpy() + 1] = value["id"].values.to_numpy()
                stream = numbers[np.frombuffer(value["ids"].as_buffer(), f"u{value['width'].as_py()}")]
                # One zero is enough between known words.
                wanted = stream > 0
                wanted[1:] |= stream[:-1] > 0
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([value["lang"].as_py()], pa.string()), "ids": pa.array([stream[wanted].tobytes()], pa.binary())
                })

    return both.mapInArrow(run, "lang string, ids binary")


def collocations(
    df: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, contained_percent: int = 100, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """Each language's `top` phrases of 2 to `longest` words: `lang, rank, phrase, a, l, r, n, score`.

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and those into words
    at spaces and tabs. `n` counts all words of the language, `a` the phrase, at least `least`; of
    all cuts in two parts with counts `l` and `r` the one with the lowest `1000 a n / (l r)`, floored,
    gives the score, of equals that after fewer words. Phrases inside a longer one that occurs at
    least `contained_percent` of `a` times are left out. Order: score, then `a`, both descending,
    then the phrase by its bytes. NULL texts have no words, NULL languages count as `und`, the
    empty language is one of its own. Repeated rows count each; empty tables give no rows; long
    texts are read whole, in stretches that end with a piece. Other columns take no part. Products
    are exact decimals. A language may have 2^25 words that occur `least` times; beyond that, ValueError.
    """
    work = work_folder(df.sparkSession)
    blocks = written(coded(df, text, lang), f"{work}/blocks")
    dictionary, totals = dictionary_of(blocks, least, work)
    found = dictionary.agg(F.max("id").alias("id")).collect()[0]["id"] or 0
    words = totals.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    bits = max(1, found.bit_length())
    if bits > MOST_BITS:
        raise ValueError(f"{found} words of one language occur {least} times; raise `least`")
    streams = written(streams_of(blocks, dictionary), f"{work}/streams")
    ranges = -(-words // RANGE_WORDS) or 1
    shape = lambda n: Shape.of(n, bits, words)
    pairs = written(counted(streams, [shape(2)], ranges, least), f"{work}/pairs")
    phrases = pairs
    if longest > 2:
        more = counted(streams, [shape(n) for n in range(3, longest + 1)], ranges, least, field_of(pairs))
        phrases = pairs.unionByName(written(more, f"{work}/longer"))
    phrases = phrases.select("lang", "ids", "f")

    single = dictionary.select("lang", F.array("id").alias("ids"), "f")
    parts = single.unionByName(phrases)
    size = F.size("ids")
    cut = phrases.select("lang", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("*", F.slice("ids", 1, F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cut = cut.join(parts.select("lang", F.col("ids").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(parts.select("lang", F.col("ids").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("CAST(up AS DECIMAL(38,0)) div CAST(down AS DECIMAL(38,0))")
    cut = cut.join(totals, "lang").withColumns({"up": F.lit(1000).cast("decimal(4,0)") * (whole("a") * whole("n")), "down": whole("l") * whole("r")})
    scored = cut.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    def inner(n: int, at: int):
        return F.when((size > n) & (size >= at + n), F.slice("ids", at + 1, n))

    inside = F.filter(F.array(*[inner(n, at) for n in range(2, longest) for at in range(longest - n + 1)]), lambda x: x.isNotNull())
    held = phrases.where(size > 2).select("lang", F.explode(inside).alias("ids"), "f").groupBy("lang", "ids").agg(F.max("f").alias("longer"))
    scored = scored.join(held, ["lang", "ids"], "left").where(
        F.coalesce(F.lit(100) * F.col("longer") < F.lit(contained_percent) * F.col("a"), F.lit(True))
    ).select("lang", "ids", "a", "best.l", "best.r", "n", "best.score")

    # Phrases whose score and count already put them behind `top` others need no words.
    order = [F.desc("score"), F.desc("a")]
    near = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place")
    near = written(near, f"{work}/near")
    spelled = (
        near.select("lang", "ids", F.posexplode("ids").alias("pos", "id")).join(dictionary.select("lang", "id", "word"), ["lang", "id"])
        .groupBy("lang", "ids").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("words"))
    )
    spelled = spelled.select("lang", "ids", F.array_join("words.word", " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    named = near.join(spelled, ["lang", "ids"]).withColumn("rank", rank).where(F.col("rank") <= top)
    return named.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
